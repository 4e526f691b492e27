"""Variant families of offers: doubtful sets of listings, and variants that another shop sells for less.

Both aggregate before they join: an offer's page, then what only sizes tell apart, then the family. No step makes pairs: some two
listings of a set differ by a colour or a number exactly if the least and the greatest list of such words differ. Only sets of at
most `most` listings are ever gathered; larger ones (families too broad to be one product, by the rule) are counted and left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import variants as V


def _keyed(products: DataFrame) -> DataFrame:
    shop = F.lower(F.trim("shop"))
    rows = products.select(
        shop.alias("shop"), "brand", "title", F.col("price").cast("bigint").alias("price"), F.concat_ws(V.PART, shop, F.trim("product_id")).alias("ref"),
        F.coalesce(F.col("page"), F.concat(F.lit("product:"), F.col("product_id")), F.lit("product:")).alias("unit"), V.title_parts(F.col("title")).alias("parts"), V.title_parts(V.head(F.col("title"))).alias("head_parts"),
    )
    key = lambda parts: V.family_of(F.col("shop"), F.col("brand"), F.col(parts))
    keyed = rows.select("shop", "brand", "title", "price", "ref", "unit", F.coalesce(key("head_parts"), key("parts")).alias("head"), V.sizes_apart_of(F.col("shop"), F.col("brand"), F.col("parts")).alias("apart"), F.col("parts.others").alias("others"))
    return keyed.where("head IS NOT NULL AND price IS NOT NULL")


def _units(keyed: DataFrame) -> DataFrame:
    """The cheapest offer of each page, with the number and a digest (free of order) of all its offers."""
    digest = F.conv(F.substring(F.md5("ref"), 1, 15), 16, 10).cast("decimal(38,0)")
    return keyed.groupBy("head", "unit").agg(F.min(F.struct("price", "title", "ref", "apart", "others", "brand")).alias("first"), F.count("*").alias("n"), F.sum(digest).cast("decimal(38,0)").alias("digest"))


def _sets(units: DataFrame, most: int) -> DataFrame:
    listings = units.groupBy("head", F.col("first.apart").alias("apart")).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    sizes = listings.groupBy("head").agg(F.count("*").alias("n"), F.min("first.others").alias("least"), F.max("first.others").alias("greatest"))
    kept = listings.join(sizes.where(F.col("n").between(2, most) & (F.col("least") != F.col("greatest"))).select("head"), "head", "left_semi")
    listing = F.struct("first.price", "first.title", "first.ref", "first.brand", "n", "apart", "digest")
    gathered = kept.groupBy("head").agg(F.array_sort(F.collect_list(listing)).alias("all"))  # most of them at most
    text = F.array_join(F.transform("all", lambda x: F.concat_ws("\x1e", x["title"], x["n"].cast("string"), x["digest"].cast("string"))), "\x1d")
    return gathered.select("head", F.substring(F.sha2(text, 256), 1, 24).alias("set_id"), F.posexplode("all").alias("at", "x")).select("set_id", "head", (F.col("at") + 1).cast("bigint").alias("listing"), "x.*")


def doubtful_sets(products: DataFrame, most: int = 40) -> DataFrame:
    """set_id, listing (from 1, cheapest first), brand, title, price, n_products: the sets of products(shop, brand, title, price, page,
    product_id) of which it isn't certain whether they are one product.

    A listing is the cheapest offer of its page (ties: title, then product), and of those that only sizes tell apart. A set has 2 to
    `most` listings of one shop, brand and head of title, some two of which differ by a colour or a number. Its id changes with its
    products, titles and order only. Offers without shop, price or two own words in the title take part in none; offers without a page
    are their own; those without an id too share one. Repeated rows count as offers.
    """
    return _sets(_units(_keyed(products)), most).select("set_id", "listing", "brand", "title", "price", F.col("n").alias("n_products"))


def set_members(products: DataFrame, most: int = 40) -> DataFrame:
    """set_id, listing, ref (shop and product) of every offer in a doubtful set."""
    keyed = _keyed(products)
    units = _units(keyed)
    placed = units.select("head", "unit", F.col("first.apart").alias("apart")).join(_sets(units, most).select("head", "apart", "set_id", "listing"), ["head", "apart"]).drop("apart")
    return keyed.select("head", "unit", "ref").join(placed, ["head", "unit"]).select("set_id", "listing", "ref")


def cheaper_elsewhere(offers: DataFrame) -> DataFrame:
    """product, variant, shop, price (least), card_shop, card_price, apart of offers(product, variant, shop, price).

    The card of a product with several variants is that of the shop with the most (ties: the cheaper, then the lesser shop), two at
    least. A shop that has one variant only, and that cheaper than the card's shop has it, stands apart (apart is true). Where no such card is
    (one variant, one shop, or the shop with the most has no name), card_shop is null and nothing stands apart. Rows without price or
    product are left out; a null variant is a variant, a null or empty shop never stands apart.
    """
    rows = offers.where("product IS NOT NULL AND price IS NOT NULL").select("product", "variant", F.coalesce("shop", F.lit("")).alias("shop"), "price")
    # All of a product is in one task from here on: one shuffle.
    held = rows.repartition(16 * rows.sparkSession.sparkContext.defaultParallelism, "product").groupBy("product", "variant", "shop").agg(F.min("price").alias("price"))
    of_shop, of_product, of_variant = Window.partitionBy("product", "shop"), Window.partitionBy("product"), Window.partitionBy("product", "variant")
    counted = held.withColumns({"n": F.count("*").over(of_shop), "least": F.min("price").over(of_shop)})
    first = F.min(F.struct((-F.col("n")).alias("n"), "least", "shop"))
    carded = counted.withColumns({"first": first.over(of_product), "some": F.min("shop").over(of_product), "other": F.max("shop").over(of_product)})
    carded = carded.withColumn("card_shop", F.when(F.expr("some <> other AND first.n <= -2 AND first.shop <> ''"), F.col("first.shop"))).drop("first", "some", "other")
    priced = carded.withColumn("card_price", F.min(F.when(F.col("shop") == F.col("card_shop"), F.col("price"))).over(of_variant))
    apart = (F.col("n") == 1) & (F.col("shop") != "") & (F.col("shop") != F.col("card_shop")) & (F.col("price") < F.col("card_price"))
    return priced.select("product", "variant", "shop", "price", "card_shop", "card_price", F.coalesce(apart, F.lit(False)).alias("apart"))
