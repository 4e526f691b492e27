"""Registered queries on specifications, with SQL that knows what the texts were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import specs as S
from offerlens.plans.offer_queries import query
from offerlens.session import spread, table

#: What each part's texts state, by its type: property, value (of the size), unit, source; in the properties' order.
_STATED = """s AS (
    SELECT *, CAST(p_size AS DOUBLE) AS z FROM part
), x AS (
    SELECT p_partkey, p_brand, 'length' AS property, z * 10 * 0.001 AS value, 'm' AS unit, 'specifications' AS source FROM s WHERE p_type = 'ECONOMY'
    UNION ALL SELECT p_partkey, p_brand, 'storage', z * 1.0, 'GB', 'specifications' FROM s WHERE p_type = 'LARGE'
    UNION ALL SELECT p_partkey, p_brand, 'power', z * 1.0, 'W', 'specifications' FROM s WHERE p_type = 'LARGE'
    UNION ALL SELECT p_partkey, p_brand, 'storage', 2 * z * 1024.0, 'GB', 'title' FROM s WHERE p_type = 'MEDIUM'
    UNION ALL SELECT p_partkey, p_brand, 'memory', z * 1.0, 'GB', 'title' FROM s WHERE p_type = 'MEDIUM'
    UNION ALL SELECT p_partkey, p_brand, 'screen', (z + 0.5) * 1.0, 'in', 'product_type' FROM s WHERE p_type = 'PROMO'
    UNION ALL SELECT p_partkey, p_brand, 'battery', z * 100 * 1.0, 'mAh', 'description' FROM s
    UNION ALL SELECT p_partkey, p_brand, 'playtime', z * 1.0, 'h', 'description' FROM s WHERE p_type <> 'SMALL'
)"""


#: The columns that a part's texts are made of.
_MADE_OF = ("p_name", "p_type", "p_size")


def _stated(parts: DataFrame, *columns: str) -> DataFrame:
    """Columns of parts and what the list, title, type and description state that are made of _MADE_OF."""
    size = F.col("p_size")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    of = lambda kind, value: F.when(F.col("p_type") == kind, value)
    listed = F.coalesce(of("ECONOMY", text("Colour: red, Extended Length (mm): ", size * 10)), of("LARGE", text("Storage: ", size, " GB; Power: 2x", size, "W | Fits: most")))
    title = F.coalesce(of("MEDIUM", text(F.col("p_name"), " ", size, "GB RAM ", 2 * size, "TB")), F.col("p_name"))
    kind = F.coalesce(of("PROMO", text("Panel ", size, ",5 inch")), F.col("p_type"))
    tail = F.when(F.col("p_type") != "SMALL", text(" Playback of ", size, " hrs")).otherwise(text(" Runtime better than ", size, " hrs"))
    prose = F.concat(text("Battery: ", size * 100, "mAh. Playtime up to ", size + 7, " hours. Some 12 W of it; USB3.0m."), tail)
    return spread(parts.select(*columns, *_MADE_OF)).select(*columns, S.stated_specs(listed, title, kind, prose).alias("specs"))


@query("prj19_stated_specs", f"WITH {_STATED} SELECT p_partkey, property, value, unit, source FROM x")
def stated_specs(spark: SparkSession, d: str) -> DataFrame:
    """What the texts of each part state."""
    return S.rows_of(_stated(table(spark, d, "part"), "p_partkey"), "p_partkey").select("p_partkey", "s.property", "s.value", "s.unit", "s.source")


@query(
    "agg39_comparable_property",
    f"""WITH {_STATED}, r AS (SELECT * FROM x WHERE property IN ('storage', 'battery', 'playtime')),
    c AS (SELECT p_brand, property, count(*) AS n_stated, max(value) AS most FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n_stated DESC, list_position(['storage', 'battery', 'playtime'], property)) AS o FROM c)
    SELECT b.p_brand, b.property, n_stated, most, (SELECT min(p_partkey) FROM r WHERE r.p_brand = b.p_brand AND r.property = b.property AND r.value = b.most) AS best_offer FROM b WHERE o = 1""",
)
def comparable_property(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand: the property by which its parts may be ranked. A brand's parts with the same texts are one row with their number and smallest key, so that their texts are read once."""
    parts = table(spark, d, "part").groupBy("p_brand", *_MADE_OF).agg(F.min("p_partkey").alias("offer_id"), F.count("*").alias("n_parts"))
    return S.comparable(_stated(parts, "p_brand", "offer_id", "n_parts"), "p_brand", count="n_parts")
