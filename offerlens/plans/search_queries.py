"""Registered queries on relevance and the identity of products, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import relevance as R
from offerlens.plans.offer_queries import query
from offerlens.session import table


@query(
    "fn23_best_answers",
    """WITH o AS (SELECT p_partkey AS offer_id, lower(p_name) AS title, lower(p_type) AS product_type, lower(p_type) || ' > ' || lower(split_part(p_name, ' ', 2)) AS category, lower(p_brand) AS brand,
        CASE WHEN p_size > 25 THEN 'big ' || lower(p_name) ELSE '' END AS keywords, 'a ' || lower(p_name) || ' of size ' || p_size AS description, p_retailprice > 1000 AS complete FROM part),
    a AS (SELECT DISTINCT lower(p_name) AS query_id, lower(split_part(p_name, ' ', 1)) AS adjective, lower(split_part(p_name, ' ', 2)) AS noun, lower(split_part(p_name, ' ', 1)) = 'hot' AS typed FROM part),
    w AS (SELECT a.*, o.*, unnest([adjective, noun, 'big']) AS x FROM a, o),
    f AS (SELECT query_id, offer_id, x, contains(title, x)::INT AS t, contains(product_type, x)::INT AS p, contains(category, x)::INT AS c, contains(brand, x)::INT AS b, contains(keywords, x)::INT AS k, contains(description, x)::INT AS d FROM w),
    s AS (SELECT query_id, offer_id, sum(greatest(t, p, c, b, k, d)) AS matched, sum(100 * t + 55 * p + 40 * c + 35 * b + 20 * k + 5 * d) AS points, sum(t) AS title_matches, sum(p + c) AS cats FROM f GROUP BY 1, 2),
    z AS (SELECT query_id, offer_id, title, matched, title_matches, points
        + CASE WHEN contains(title, query_id) THEN 150 ELSE 0 END + CASE WHEN title_matches >= 1 THEN 80 ELSE 0 END + CASE WHEN cats > 0 THEN 20 ELSE 0 END
        + CASE WHEN list_contains(string_split(title, ' '), noun) THEN 60 ELSE 0 END + CASE WHEN typed AND product_type IN ('promo', 'small') THEN 130 ELSE 0 END
        + CASE WHEN list_contains(string_split(title, ' '), 'ring') THEN -220 ELSE 40 END + CASE WHEN complete THEN 25 ELSE 0 END AS score
        FROM s JOIN a USING (query_id) JOIN o USING (offer_id)
        WHERE (contains(title, noun) OR contains(product_type, noun) OR contains(category, noun) OR contains(brand, noun) OR contains(keywords, noun) OR contains(description, noun)) AND (NOT typed OR product_type IN ('promo', 'small'))),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, score DESC, title_matches DESC, title, offer_id) AS place FROM z)
    SELECT query_id, place, offer_id, CAST(matched AS BIGINT) AS matched, CAST(score AS BIGINT) AS score, CAST(title_matches AS BIGINT) AS title_matches FROM r WHERE place <= 10""",
)
def best_answers(spark: SparkSession, d: str) -> DataFrame:
    """The ten best parts for each name of a part: its noun is required, the adjective and "big" add points; rings count as accessories."""
    part = table(spark, d, "part")
    name, kind = F.lower("p_name"), F.lower("p_type")
    word = lambda i: F.get(F.split(name, " "), F.lit(i))
    offers = part.select(
        F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"), F.concat(kind, F.lit(" > "), word(1)).alias("category"), F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("big "), name)).alias("keywords"), F.concat(F.lit("a "), name, F.lit(" of size "), F.col("p_size").cast("string")).alias("description"), (F.col("p_retailprice") > 1000).alias("complete"),
    )
    types = F.when(word(0) == "hot", F.array(F.lit("promo"), F.lit("small")))
    asked = part.select(name.alias("query_id"), F.array(word(1)).alias("required"), F.array(word(0), word(1), F.lit("big")).alias("words"), name.alias("phrase"), types.alias("types"), F.lit(False).alias("accessory")).distinct()
    return R.best_answers(asked, offers, 10, ["ring"])


#: A trade number's twelve digits of each part; its check digit, which large parts get wrong; nothing but zeros for medium ones, and a part number for those and promoted ones.
_CODES = """c AS (SELECT p_partkey, p_brand, p_type, lpad(CAST(400000000000 + p_partkey AS VARCHAR), 12, '0') AS body FROM part),
    g AS (SELECT *, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(body[i] AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS digit FROM c)"""


def _coded(spark: SparkSession, d: str) -> DataFrame:
    body = F.lpad((F.lit(400_000_000_000) + F.col("p_partkey")).cast("string"), 12, "0")
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substr(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    digit = (10 - F.aggregate(digits, F.lit(0), lambda a, b: a + b) % 10) % 10
    kind = F.col("p_type")
    code = F.when(kind == "ECONOMY", F.concat(F.lit(" "), body, F.lit("-"), digit.cast("string"))).when(kind == "LARGE", F.concat(body, ((digit + 1) % 10).cast("string"))).when(kind == "MEDIUM", "0000000000000")
    part = F.when(kind.isin("MEDIUM", "PROMO"), F.concat(F.lit("  X "), F.col("p_partkey").cast("string"))).when(kind == "SMALL", "plain")
    return table(spark, d, "part").select("p_partkey", "p_brand", code.alias("ean"), F.lit(None).cast("string").alias("gtin"), part.alias("mpn"))


@query(
    "prj11_same_product_key",
    f"""WITH {_CODES} SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'gtin:0' || body || digit WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'mpn:' || lower(p_brand) || '|x ' || p_partkey ELSE '' END AS product_key FROM g""",
)
def same_product_key(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).select("p_partkey", T.same_product_key([F.col("gtin"), F.col("ean")], F.col("p_brand"), [F.col("mpn")]).alias("product_key"))


@query(
    "prj12_identity_key",
    f"""WITH {_CODES} SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'gtin:0' || body || digit WHEN p_type = 'LARGE' THEN 'gtin:0' || body || (digit + 1) % 10
        WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'mpn:' || lower(p_brand) || '|x ' || p_partkey WHEN p_type = 'SMALL' THEN 'mpn:' || lower(p_brand) || '|plain' ELSE '' END AS identity FROM g""",
)
def identity_key(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).select("p_partkey", T.identity_key([F.col("gtin"), F.col("ean")], F.col("p_brand"), [F.col("mpn")]).alias("identity"))
