"""Offers, and what is computed on rows of them: gates, keys, ranks, picks, runs, caps and reports.

The tables given stand in for feeds: a line item is an offer, a part its product, a supplier its shop, the ship date its night.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.price import pence, sale_pence


def offers_of(lineitem: DataFrame) -> DataFrame:
    """The canonical offer row: offer_id, product, shop, price and sale_price (pence), night, flag, state."""
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("offer_id"),
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("shop"),
        pence(F.col("l_extendedprice")).alias("price"),
        sale_pence(pence(F.col("l_extendedprice")), F.col("l_discount")).alias("sale_price"),
        F.col("l_shipdate").cast("date").alias("night"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("state"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )


def reasons(**rules: Column) -> Column:
    """The sorted names of the rules that hold: an explainable gate in one expression."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in sorted(rules.items())]))


def gated(offers: DataFrame, least: int, most_quantity: int) -> DataFrame:
    """Adds the reasons that hold a row back, and whether it is eligible: it is if there are none."""
    found = reasons(price_too_low=F.col("price") < least, returned=F.col("flag") == "R", not_live=F.col("state") != "O", bulk_only=F.col("quantity") > most_quantity)
    return offers.withColumn("reasons", F.array_join(found, ",")).withColumn("eligible", F.col("reasons") == "")


def cheapest(offers: DataFrame, key: str = "product") -> DataFrame:
    """One row for each key: its cheapest offer (ties to the smaller id), with the numbers of offers and of shops."""
    own = F.min(F.struct("price", "offer_id", "shop"))
    return offers.groupBy(key).agg(own.alias("best"), F.count("*").alias("n_offers"), F.count_distinct("shop").alias("n_shops")).select(key, "best.offer_id", "best.price", "best.shop", "n_offers", "n_shops")


def competition_ranks(offers: DataFrame, key: str) -> DataFrame:
    """Ranks of prices within the key: equal ones share a rank. Adds the place of each row and the roles of the ends."""
    by = Window.partitionBy(key)
    rank = F.rank().over(by.orderBy("price"))
    n = F.count("*").over(by)
    low, high = F.min("price").over(by), F.max("price").over(by)
    role = F.when(n == 1, "only").when(F.col("price") == low, "lowest").when(F.col("price") == high, "highest").otherwise(F.concat(F.col("rank").cast("string"), F.lit("th")))
    return offers.withColumn("rank", rank.cast("bigint")).withColumn("role", role)


def trimmed_middle(offers: DataFrame, key: str) -> DataFrame:
    """Each key's lower median price by position, after its tail of prices at twice the one before or more is left out."""
    order = Window.partitionBy(key).orderBy("price", "offer_id")
    placed = offers.withColumns({"rn": F.row_number().over(order), "jump": F.coalesce(F.col("price") >= 2 * F.lag("price").over(order), F.lit(False))})
    counted = placed.withColumn("counted", F.max(F.when(~F.col("jump"), F.col("rn"))).over(Window.partitionBy(key)))
    middle = F.floor((F.col("counted") - 1) / 2) + 1
    return counted.where(F.col("rn") == middle).select(key, "offer_id", F.col("price").alias("middle_price"), F.col("counted").cast("bigint").alias("counted"))


def recommended(offers: DataFrame, middles: DataFrame, key: str) -> DataFrame:
    """Of the offers strictly between the ends, the one nearest the middle price; ties to the cheaper, then the smaller id."""
    by = Window.partitionBy(key)
    inside = offers.withColumns({"low": F.min("price").over(by), "high": F.max("price").over(by)}).where("price > low AND price < high")
    near = inside.join(middles.select(key, "middle_price"), key).groupBy(key).agg(F.min(F.struct(F.abs(F.col("price") - F.col("middle_price")).alias("far"), "price", "offer_id")).alias("best"))
    return near.select(key, F.col("best.offer_id").alias("offer_id"), F.col("best.price").alias("price"), F.col("best.far").alias("far"))


def evenly_spaced(offers: DataFrame, key: str, k: int) -> DataFrame:
    """k rows of each key at even distances in the order of price."""
    order = Window.partitionBy(key).orderBy("price", "offer_id")
    placed = offers.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(key))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((2 * i + 1) * F.col("n") / (2 * k)))
    return placed.where(F.array_contains(wanted, F.col("i").cast("bigint"))).select(key, "offer_id", "price", F.col("i").cast("bigint").alias("place"))


def runs(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps and islands: runs of nights in a row (night) on which a key kept its price."""
    order = Window.partitionBy(*keys).orderBy("night")
    broken = (F.datediff("night", F.lag("night").over(order)) != 1) | (F.col("price") != F.lag("price").over(order))
    island = sightings.withColumn("break", F.coalesce(broken, F.lit(True)).cast("int")).withColumn("run", F.sum("break").over(order))
    return island.groupBy(*keys, "run").agg(F.min("night").alias("first_night"), F.max("night").alias("last_night"), F.count("*").alias("nights"), F.min("price").alias("price")).withColumn("run", F.col("run").cast("bigint"))


def as_of(asked: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """The latest record (price) at or before each asked night: one sort of both sides together, no range join."""
    both = asked.select(*keys, "night", "ask_id", F.lit(None).cast("bigint").alias("price"), F.lit(None).cast("date").alias("since")).unionByName(records.select(*keys, "night", F.lit(None).cast("string").alias("ask_id"), "price", F.col("night").alias("since")))
    before = Window.partitionBy(*keys).orderBy("night", F.col("ask_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    return both.withColumns({"price": last("price"), "since": last("since")}).where("ask_id IS NOT NULL").select("ask_id", *keys, "night", "price", "since")


def shares(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Rows and share (in ten-thousandths) of each value of each dimension: grouping sets over one scan."""
    sets = ", ".join(f"({c})" for c in dimensions)
    df.createOrReplaceTempView("__balance")
    name = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{label}'" for c, label in dimensions.items()) + " END"
    value = "coalesce(" + ", ".join(f"CAST({c} AS string)" for c in dimensions) + ")"
    grouped = df.sparkSession.sql(f"SELECT {name} AS dimension, {value} AS value, count(*) AS n FROM __balance GROUP BY GROUPING SETS ({sets})")
    total = Window.partitionBy("dimension")
    return grouped.withColumn("share", F.floor(F.col("n") * 10_000 / F.sum("n").over(total)).cast("bigint"))


def cap_size(groups: DataFrame, share: int) -> DataFrame:
    """The largest cap C at which no group holds over share percent of what is kept, from the groups' sizes (name, n) alone."""
    order = Window.orderBy(F.desc("n"), "name")  # one row for each group, not for each offer
    rest = groups.withColumns({"k": F.row_number().over(order), "rest": F.sum("n").over(Window.partitionBy()) - F.sum("n").over(order), "lead": F.lead("n", 1, 0).over(order)})
    room = rest.where(F.lit(share) * F.col("k") < 100).withColumn("cap", F.col("rest") * share / (100 - share * F.col("k")))
    hit = room.where((F.col("lead") <= F.col("cap")) & (F.col("cap") <= F.col("n"))).agg(F.min(F.struct("k", F.floor("cap").alias("cap")))["cap"].alias("cap"))
    whole = rest.agg((F.max("n") * 100 <= F.sum("n") * share).alias("fits"), F.max("n").alias("most"))
    return hit.crossJoin(whole).select(F.when(F.col("fits"), F.col("most")).when(F.col("cap") >= 1, F.col("cap")).cast("bigint").alias("cap"))


def log_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Bins of equal ratio from the least to the greatest value; the last one takes its upper end."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.floor(F.ln(F.col(value) / F.col("low")) / F.ln(F.col("high") / F.col("low")) * bins)
    return df.crossJoin(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def fenced(offers: DataFrame, key: str) -> DataFrame:
    """Prices outside 1.5 quartile distances (quartiles by place) that are also twice the middle or half of it, or beyond."""
    order = Window.partitionBy(key).orderBy("price", "offer_id")
    placed = offers.withColumns({"i": F.row_number().over(order) - 1, "last": F.count("*").over(Window.partitionBy(key)) - 1})
    at = lambda part: F.max(F.when(F.col("i") == F.floor(F.col("last") * part / 4), F.col("price"))).over(Window.partitionBy(key))
    q = placed.withColumns({"q1": at(1), "q2": at(2), "q3": at(3)})
    far = (2 * F.col("price") < 2 * F.col("q1") - 3 * (F.col("q3") - F.col("q1"))) | (2 * F.col("price") > 2 * F.col("q3") + 3 * (F.col("q3") - F.col("q1")))
    return q.where(far & ((F.col("price") >= 2 * F.col("q2")) | (2 * F.col("price") <= F.col("q2")))).select("offer_id", key, "price", F.col("q2").alias("middle_price"))


def top_k(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; the sort keeps k rows for each group and task before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))


def apportioned(weights: DataFrame, seats: int) -> DataFrame:
    """Largest remainders: seats for each name by its weight, what is left over to the largest remainders, then names."""
    all_ = Window.partitionBy()
    exact = weights.withColumns({"whole": F.floor(F.col("n") * seats / F.sum("n").over(all_)).cast("bigint"), "rest": (F.col("n") * seats) % F.sum("n").over(all_)})
    left = F.lit(seats) - F.sum("whole").over(all_)
    placed = exact.withColumns({"left": left, "rn": F.row_number().over(Window.orderBy(F.desc("rest"), "name"))})
    return placed.select("name", "n", (F.col("whole") + (F.col("rn") <= F.col("left")).cast("bigint")).alias("seats"))


def fair_quotas(groups: DataFrame, percent: int) -> DataFrame:
    """A quota for each of groups (name, n; one row each) that together make percent of all rows, rounded down: the smallest ones are kept whole, as long as
    none of them is above the mean of what is left for it and the larger ones; from there on all have that mean, and the first by size, then name, one row more while the division leaves any."""
    all_ = Window.partitionBy()  # one row for each group
    rising = Window.orderBy("n", "name")
    placed = groups.withColumns({"i": F.row_number().over(rising) - 1, "rest": F.floor(F.sum("n").over(all_) * percent / 100) - F.sum("n").over(rising) + F.col("n"), "left": F.count("*").over(all_)})
    split = placed.withColumn("left", F.col("left") - F.col("i")).withColumn("equal", F.floor(F.col("rest") / F.col("left"))).withColumn("larger", F.col("n") > F.col("equal"))
    at = F.min(F.when(F.col("larger"), F.struct("i", "rest", "left", "equal"))).over(all_)  # the smallest group that an equal share cuts; so does it all larger ones
    ranked = split.withColumns({"at": at, "k": F.row_number().over(Window.orderBy(F.desc("n"), "name"))})
    extra = (F.col("k") <= F.col("at.rest") - F.col("at.equal") * F.col("at.left")).cast("bigint")
    return ranked.select("name", "n", F.when(F.col("larger"), F.col("at.equal") + extra).otherwise(F.col("n")).cast("bigint").alias("quota"))


#: Ages in days beyond which rows are counted as old (fixed values).
AGES = (7, 30, 90, 180, 365)


def freshness(offers: DataFrame, key: str, today: str) -> DataFrame:
    """Of each key: rows, dated rows, their median age in days (a later date counts as 0), those older than each of AGES, stock."""
    age = F.greatest(F.lit(0), F.datediff(F.to_date(F.lit(today)), F.col("night")))
    aged = offers.withColumn("age", F.when(F.col("night").isNotNull(), age))
    older = [F.count_if(F.col("age") > n).alias(f"older_than_{n}") for n in AGES]
    return aged.groupBy(key).agg(F.count("*").alias("products"), F.count("age").alias("dated"), F.median("age").alias("median_age_days"), *older, F.count_if(F.col("quantity") <= 0).alias("quantity_zero"), F.count_if(F.col("quantity") > 0).alias("quantity_positive"))


def majority(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """Each key's most frequent value (ties to the one seen first, then the smaller), how many rows have it and how many haven't."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("first"), F.col(value).alias("value")))
    return counted.groupBy(key).agg(best.alias("best"), F.sum("n").alias("all")).select(key, F.col("best.value").alias(value), (-F.col("best.minus")).alias("kept"), (F.col("all") + F.col("best.minus")).alias("dropped"))


def stock_of_catalogue(offers: DataFrame, catalogue: DataFrame, keys: list[str], today: str, days: int) -> DataFrame:
    """Offers (stock), overridden by a catalogue (keys, seen, in_stock; one row a key) that was seen at most so many days ago."""
    fresh = F.coalesce(F.datediff(F.to_date(F.lit(today)), F.col("seen")) <= days, F.lit(False))
    own = F.when(F.col("in_stock"), "in_stock").otherwise("sold_out")
    return offers.join(catalogue, keys, "left").withColumn("overridden", fresh).withColumn("stock", F.when(F.col("overridden"), own).otherwise(F.col("stock"))).drop("in_stock")


def role_labels(offers: DataFrame, key: str) -> DataFrame:
    """What a choice's label says of its price among the key's: no price, the only one, lowest, nth lowest, highest. The texts are fixed values."""
    by = Window.partitionBy(key)
    placed = offers.withColumns({"rank": F.rank().over(by.orderBy(F.asc_nulls_last("price"))), "comparable": F.count("price").over(by), "choices": F.count("*").over(by)})
    scope = F.when(F.col("choices") == 4, "these four").otherwise(F.concat(F.lit("these "), F.col("choices").cast("string")))
    nth = F.when(F.col("rank") == 2, "2nd").when(F.col("rank") == 3, "3rd").otherwise(F.concat(F.col("rank").cast("string"), F.lit("th")))
    label = (
        F.when(F.col("price").isNull(), "Price not comparable with the others")
        .when(F.col("comparable") <= 1, "Only option with a comparable price")
        .when(F.col("rank") == 1, F.concat(F.lit("Lowest price of "), scope))
        .when(F.col("rank") >= F.col("comparable"), F.concat(F.lit("Highest price of "), scope))
        .when(F.col("rank") <= 5, F.concat(nth, F.lit(" lowest price of "), scope))
        .otherwise(F.concat(F.lit("Price rank "), F.col("rank").cast("string"), F.lit(" of "), scope))
    )
    return placed.withColumn("label", label)
