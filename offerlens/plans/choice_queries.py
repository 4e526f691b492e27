"""Registered query on the choices of kinds, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.choices import kind_choices
from offerlens.plans.offer_queries import query
from offerlens.session import table


@query(
    "agg17_kind_choices",
    """WITH s AS (SELECT source AS shop, list_filter(string_split_regex(unnest(string_split_regex(lower(text), '[.!?\\n]')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    a AS (SELECT shop, w[len(w)] AS kind, CASE WHEN len(w) > 1 THEN w[len(w) - 1] END AS word, CASE WHEN len(w) > 2 THEN w[len(w) - 2] END AS before FROM s WHERE len(w) > 0),
    k AS (SELECT kind, count(*) AS of_kind FROM a GROUP BY 1 HAVING count(*) >= 50),
    t AS (SELECT kind, before, word, count(*) AS n, min(shop) AS low, max(shop) AS high FROM a WHERE word IS NOT NULL AND kind IN (SELECT kind FROM k) GROUP BY 1, 2, 3),
    w AS (SELECT kind, word, CAST(sum(n) AS BIGINT) AS n, min(low) AS low, max(high) AS high FROM t GROUP BY 1, 2),
    g AS (SELECT word, min(low) <> max(high) AS shared FROM w GROUP BY 1 HAVING count(*) FILTER (n >= 3) < 30),
    m AS (SELECT before, word FROM t WHERE before IS NOT NULL AND n >= 3 GROUP BY 1, 2 HAVING count(*) >= 2),
    p AS (SELECT * FROM t WHERE before IS NOT NULL AND (regexp_full_match(before, '[0-9]+') OR (before, word) IN (SELECT (before, word) FROM m)) AND (kind, before) NOT IN (SELECT (kind, word) FROM w WHERE n >= 3)),
    h AS (SELECT kind, word, sum(n) AS within FROM p GROUP BY 1, 2),
    r AS (SELECT w.*, shared, coalesce(within * 100 >= n * 75, false) AS half FROM w JOIN g USING (word) LEFT JOIN h USING (kind, word)),
    c AS (SELECT kind, word AS choice, n, low, high, shared FROM r WHERE NOT half UNION ALL SELECT p.kind, before || ' ' || p.word, p.n, p.low, p.high, r.shared FROM p JOIN r ON r.kind = p.kind AND r.word = p.word WHERE half),
    f AS (SELECT kind, choice, n, of_kind, row_number() OVER (PARTITION BY kind ORDER BY n DESC, choice) AS place, count(*) OVER (PARTITION BY kind) AS choices
        FROM c JOIN k USING (kind) WHERE n >= 5 AND (coalesce(low <> high, false) OR coalesce(shared, false)) AND n * 100 < of_kind * 90)
    SELECT kind, choice, n, of_kind, place FROM f WHERE place <= 12 AND choices >= 2""",
)
def choices(spark: SparkSession, d: str) -> DataFrame:
    """Of the last words of all sentences, as nouns: the words before them that part them."""
    at = lambda w, i: F.get(w, F.size(w) - 1 - i)
    last = lambda w: F.struct(at(w, 0).alias("kind"), at(w, 1).alias("word"), at(w, 2).alias("before"))
    ends = lambda s: F.transform(F.array(F.filter(F.split(s, "[^a-z0-9]+"), lambda w: w != "")), last)[0]
    # One expression under the explode: a filter on the words would be pushed below it and split every sentence again.
    sentences = F.explode(F.transform(F.split(F.lower("text"), r"[.!?\n]"), ends))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("shop"), sentences.alias("s"))
    return kind_choices(rows.select("shop", "s.*"), min_group=5, generic_kinds=30)
