"""Registered queries on variants of products, with SQL that knows what the titles were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import variants as V
from offerlens.operators.families import cheaper_elsewhere, doubtful_sets, set_members
from offerlens.plans.offer_queries import query
from offerlens.session import table

#: Titles of parts: the name, then a size, an amount, a number or nothing by the type; what each word is, by its place.
_TITLES = """t AS (
    SELECT p_partkey, substr(p_brand, 1, 7) AS shop, CAST(round(p_retailprice * 100) AS BIGINT) AS price, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size AS z, p_size % 6 AS m, p_type AS k,
        concat(p_name, ' Set', CASE p_type WHEN 'ECONOMY' THEN concat(' - Size ', p_size) WHEN 'SMALL' THEN concat(' ', p_size, '.5L') WHEN 'MEDIUM' THEN concat(', ', p_size, 'GB Disk') WHEN 'LARGE' THEN ' XL'
            WHEN 'PROMO' THEN concat(' ', p_size % 6) ELSE '' END) AS title,
        CASE WHEN p_size % 3 > 0 THEN concat(p_name, '/', p_size % 3) END AS page
    FROM part
), w AS (
    SELECT *, a IN ('red', 'blue', 'green', 'black', 'white') AS coloured, a IN ('small', 'large') AS sized FROM t
), y AS (
    SELECT *, concat_ws(' ', CASE WHEN NOT coloured AND NOT sized THEN a END, b, 'set') AS own,
        concat_ws(' ', CASE WHEN k = 'PROMO' THEN CAST(m AS VARCHAR) END, CASE WHEN coloured THEN a END) AS others,
        array_to_string(list_sort(list_filter([CASE WHEN sized THEN a END, CASE k WHEN 'ECONOMY' THEN 'size' END, CASE k WHEN 'ECONOMY' THEN concat('~', z) WHEN 'SMALL' THEN concat(z, '5l') WHEN 'MEDIUM' THEN concat(z, 'gb') WHEN 'LARGE' THEN 'xl' END], lambda x: x IS NOT NULL)), ' ') AS sizes
    FROM w
), f AS (
    SELECT *, concat(own, CASE k WHEN 'MEDIUM' THEN ' disk' ELSE '' END) AS whole, concat(lower(shop), chr(31), chr(31)) AS pre FROM y
)"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as listings of the shops that the first figure of their brand names."""
    of = lambda kind, *texts: F.when(F.col("p_type") == kind, F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in texts]))
    size = F.col("p_size")
    tail = F.coalesce(of("ECONOMY", " - Size ", size), of("SMALL", " ", size, ".5L"), of("MEDIUM", ", ", size, "GB Disk"), of("LARGE", " XL"), of("PROMO", " ", size % 6), F.lit(""))
    page = F.when(size % 3 > 0, F.concat("p_name", F.lit("/"), (size % 3).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("shop"), F.lit(None).cast("string").alias("brand"), F.concat("p_name", F.lit(" Set"), tail).alias("title"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"), page.alias("page"), F.col("p_partkey").cast("string").alias("product_id"))


@query("prj17_title_parts", f"WITH {_TITLES} SELECT p_partkey, title, whole AS own, sizes, others FROM f")
def title_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each title's own words, sizes and other variant words; a number after a size word is a size (WIN17)."""
    parted = _titles(spark, d).select("p_partkey", "title", V.title_parts(F.col("title")).alias("p"))
    return parted.select("p_partkey", "title", *[F.array_join(f"p.{c}", " ").alias(c) for c in ("own", "sizes", "others")])


@query(
    "prj18_variant_keys",
    f"WITH {_TITLES} SELECT p_partkey, concat(pre, whole) AS family, concat(pre, own) AS head, concat(pre, whole, chr(31), others) AS apart FROM f",
)
def variant_keys(spark: SparkSession, d: str) -> DataFrame:
    """The family, head and sizes-apart keys of each title."""
    shop, brand, title = F.lower("shop"), F.col("brand"), F.col("title")
    return _titles(spark, d).select("p_partkey", V.family_key(shop, brand, title).alias("family"), V.head_key(shop, brand, title).alias("head"), V.sizes_apart_key(shop, brand, title).alias("apart"))


#: Sets of the titles above: cheapest of a page, cheapest of what sizes tell apart, then families with two kinds of other words.
_SETS = f"""{_TITLES}, o AS (
    SELECT concat(pre, own) AS head, coalesce(page, concat('product:', p_partkey)) AS unit, price, title, concat(lower(shop), chr(31), p_partkey) AS ref, concat(whole, chr(31), others) AS apart, others FROM f
), u AS (
    SELECT *, row_number() OVER (PARTITION BY head, unit ORDER BY price, title, ref) AS rn FROM o
), p AS (
    SELECT x.head, x.unit, c.price, c.title, c.ref, c.apart, c.others, x.ref AS member FROM o x JOIN u c ON c.rn = 1 AND c.head = x.head AND c.unit = x.unit
), l AS (
    SELECT head, apart, count(*) AS n, sum(CAST('0x' || substr(md5(member), 1, 15) AS BIGINT)) AS digest, min((price, title, ref)) AS best, min(others) AS others FROM p GROUP BY head, apart
), s AS (
    SELECT head, sum(1) AS listings FROM l GROUP BY head HAVING count(*) BETWEEN 2 AND 40 AND count(DISTINCT others) > 1
), r AS (
    SELECT l.*, row_number() OVER (PARTITION BY head ORDER BY best) AS listing FROM l JOIN s USING (head)
), i AS (
    SELECT head, substr(sha256(string_agg(concat_ws(chr(30), best[2], n, digest), chr(29) ORDER BY listing)), 1, 24) AS set_id FROM r GROUP BY head
)"""


@query("set9_doubtful_sets", f"WITH {_SETS} SELECT set_id, listing, CAST(NULL AS VARCHAR) AS brand, best[2] AS title, best[1] AS price, n AS n_products FROM r JOIN i USING (head)")
def doubtful(spark: SparkSession, d: str) -> DataFrame:
    """The sets of listings that may be one product."""
    return doubtful_sets(_titles(spark, d))


@query("set9_set_members", f"WITH {_SETS} SELECT set_id, listing, member AS ref FROM p JOIN r USING (head, apart) JOIN i USING (head)")
def members(spark: SparkSession, d: str) -> DataFrame:
    """The products of each doubtful set's listings."""
    return set_members(_titles(spark, d))


@query(
    "set8_cheaper_elsewhere",
    """WITH h AS (SELECT concat(p_brand, ' ', p_name) AS product, p_partkey AS variant, l_suppkey AS shop, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
    n AS (SELECT *, count(*) OVER (PARTITION BY product, shop) AS held, min(price) OVER (PARTITION BY product, shop) AS least FROM h),
    c AS (SELECT product, first(shop ORDER BY held DESC, least, CAST(shop AS VARCHAR)) AS card_shop FROM n GROUP BY product HAVING max(held) >= 2 AND count(DISTINCT shop) > 1)
    SELECT n.product, n.variant, CAST(n.shop AS VARCHAR) AS shop, n.price, CAST(card_shop AS VARCHAR) AS card_shop, x.price AS card_price, coalesce(n.held = 1 AND n.shop <> card_shop AND n.price < x.price, false) AS apart
    FROM n LEFT JOIN c USING (product) LEFT JOIN h x ON x.product = n.product AND x.variant = n.variant AND x.shop = c.card_shop""",
)
def cheaper(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and name as variants of a product: which shops' only variant stands apart, cheaper than on the card."""
    part = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("product"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("variant"), F.col("l_suppkey").cast("string").alias("shop"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"))
    least = lines.repartition(16 * spark.sparkContext.defaultParallelism, "variant").groupBy("variant", "shop").agg(F.min("price").alias("price"))
    return cheaper_elsewhere(least.join(part, F.col("variant") == F.col("p_partkey")).drop("p_partkey"))
