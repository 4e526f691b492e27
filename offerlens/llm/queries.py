"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import ann, collocations, conversations, decontaminate, html_text, line_dedup, mtree, near_dedup, packing, quality, substring_dedup, url_filter, warc
from offerlens.llm.common import table

#: The rules of op10's contract.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def vocabulary() -> str:
    """The tokenizer file of op8's contract; its place is the installed package's, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op9_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op11_mtree_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.best_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn_quality": op1_knn_quality,
    "op2_multi_index_ann": op2_multi_index_ann,
    "op3_warc_roundtrip": op3_warc_roundtrip,
    "op4_spaced_seed_decontamination": op4_spaced_seed_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_text": op6_html_text,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_chosen_path_near_dedup": op9_chosen_path_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_mtree_products": op11_mtree_products,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_warc_roundtrip": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op11_mtree_products": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
    """,
    "op13_collocations": """
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(
                string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
                lambda x: list_filter(string_split_regex(x, '[ \t]+'), lambda w: w <> ''))) AS ws FROM documents
        ), w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
        t AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM w),
        f AS (
            SELECT lang, 1 AS words, x AS g, count(*) AS f FROM t GROUP BY ALL
            UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM t WHERE y IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM t WHERE z IS NOT NULL GROUP BY ALL
        ), h AS (SELECT lang, words, g, f FROM f WHERE f >= 10),
        c AS (SELECT lang, words, g, f AS a, string_split(g, ' ') AS q FROM h WHERE words > 1),
        u AS (
            SELECT lang, words, g, a, 1 AS k, q[1] AS g1, array_to_string(q[2:words], ' ') AS g2 FROM c
            UNION ALL SELECT lang, words, g, a, 2, q[1] || ' ' || q[2], q[3] FROM c WHERE words = 3
        ), s AS (
            SELECT u.lang, u.words, u.g, a, k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
            FROM u JOIN h l ON l.lang = u.lang AND l.g = u.g1 JOIN h r ON r.lang = u.lang AND r.g = u.g2
        ), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
        m AS (
            SELECT lang, g, max(a) AS longer FROM (
                SELECT lang, q[1] || ' ' || q[2] AS g, a FROM c WHERE words = 3 UNION ALL SELECT lang, q[2] || ' ' || q[3], a FROM c WHERE words = 3
            ) GROUP BY ALL
        ), d AS (
            SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * a
        ), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
    """,
}
