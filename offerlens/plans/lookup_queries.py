"""Registered queries on names, spelling and hierarchies, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import hierarchy as H
from offerlens.operators import names as N
from offerlens.operators import spelling as S
from offerlens.plans.offer_queries import query
from offerlens.session import table

#: Words of a text as DuckDB reads them, lower case; and the names, with their queries, of the lookups: all words and neighbouring words of the
#: benchmark are known, the first word and the first two of each turn of a conversation are asked.
_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_NAMES = f"""b AS (SELECT {_WORDS} AS w FROM benchmark),
    n AS (
        SELECT DISTINCT unnest(w) AS name, 'exact_canonical' AS kind FROM b
        UNION ALL SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 'spelling_family' FROM b
    ), e AS (SELECT name AS entry_id, name, string_split(name, ' ')[1] AS term, kind FROM n),
    t AS (SELECT {_WORDS} AS w FROM conversations),
    a AS (SELECT DISTINCT q AS query_id, q AS query FROM (SELECT w[1] AS q FROM t WHERE len(w) > 0 UNION ALL SELECT w[1] || ' ' || w[2] FROM t WHERE len(w) > 1))"""
_OVERLAP = """(SELECT coalesce(sum(CASE WHEN best >= 0.72 THEN best END), 0) FROM (
    SELECT i, max(CASE WHEN levenshtein(x, y) <= 2 THEN 1 - levenshtein(x, y)::DOUBLE / greatest(len(x), len(y)) ELSE 0 END) AS best
    FROM (SELECT unnest(list_zip(qw, range(len(qw))), recursive := true)) u(x, i), (SELECT unnest(nw)) v(y) GROUP BY i)) / greatest(len(qw), len(nw))"""


def _skeleton(c: str) -> str:
    """Runs of a consonant once, without back-references, which DuckDB's patterns lack."""
    x = f"regexp_replace(lower({c}), '[^b-df-hj-np-tv-z]', '', 'g')"
    for letter in "bcdfghjklmnpqrstvwxyz":
        x = f"regexp_replace({x}, '{letter}+', '{letter}', 'g')"
    return x


_SCORED = f"""j AS (
        SELECT query_id, query, entry_id, name, term, kind, replace(query, ' ', '') AS qj, replace(name, ' ', '') AS nj, replace(term, ' ', '') AS tj,
            string_split(query, ' ') AS qw, string_split(name, ' ') AS nw, levenshtein(replace(query, ' ', ''), replace(name, ' ', '')) AS d FROM a, e
        WHERE abs(len(replace(query, ' ', '')) - len(replace(name, ' ', ''))) <= 4
    ), near AS (SELECT * FROM j WHERE d <= CASE WHEN len(qj) >= 10 AND len(nj) >= 10 THEN 4 ELSE 3 END AND 0.75 * (1 - d::DOUBLE / greatest(len(qj), len(nj))) >= 0.34 - 1e-9),
    k AS (SELECT DISTINCT w, {_skeleton('w')} AS s FROM (SELECT qj AS w FROM near UNION SELECT nj FROM near UNION SELECT tj FROM near)),
    o AS (SELECT DISTINCT query, name, qw, nw FROM near), ov AS (SELECT query, name, {_OVERLAP} AS overlap FROM o),
    p AS (
        SELECT near.*, 0.75 * (1 - d::DOUBLE / greatest(len(qj), len(nj))) + 0.25 * overlap AS s0, qj = nj AND query <> name AS same, kind = 'spelling_family' AS family,
            kq.s <> '' AND kq.s = kn.s AS by_name, kq.s <> '' AND kq.s <> kn.s AND kq.s = kt.s AS by_term
        FROM near JOIN ov USING (query, name) JOIN k kq ON kq.w = qj JOIN k kn ON kn.w = nj JOIN k kt ON kt.w = tj
    ), s1 AS (SELECT *, CASE WHEN same THEN least(1, s0 + 0.03) ELSE s0 END AS x1 FROM p), s2 AS (SELECT *, CASE WHEN family THEN least(1, x1 + 0.04) ELSE x1 END AS x2 FROM s1),
    s3 AS (SELECT *, CASE WHEN by_name THEN least(1, x2 + 0.06) WHEN by_term THEN least(1, x2 + 0.05) ELSE x2 END AS x3 FROM s2),
    r AS (
        SELECT *, round(x3, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(x3, 6) DESC, kind <> 'exact_canonical', entry_id) AS place,
            array_to_string(list_filter([CASE WHEN by_term THEN 'canonical_consonant_skeleton_match' END, CASE WHEN by_name THEN 'consonant_skeleton_match' END, 'fuzzy_match',
                CASE WHEN same THEN 'joined_words_match' END, CASE WHEN family THEN 'spelling_family_match' END], lambda v: v IS NOT NULL), ',') AS reasons
        FROM s3 WHERE round(x3, 6) >= 0.72
    )"""


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, d, "benchmark").select(T.words(F.col("text")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    single = known.select(F.explode("w").alias("name")).distinct().withColumn("kind", F.lit("exact_canonical"))
    double = known.where("size(w) > 1").select(F.explode(pairs).alias("name")).distinct().withColumn("kind", F.lit("spelling_family"))
    entries = single.unionByName(double).select(F.col("name").alias("entry_id"), "name", F.substring_index("name", " ", 1).alias("term"), "kind")
    turns = table(spark, d, "conversations").select(T.words(F.col("text")).alias("w"))
    starts = F.array(F.get("w", F.lit(0)), F.when(F.size("w") > 1, F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))))
    asked = turns.select(F.explode(F.array_compact(starts)).alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    return asked, entries


@query("jn11_nearest_names", f"WITH {_NAMES}, {_SCORED} SELECT query_id, place, entry_id, score, reasons FROM r WHERE place <= 3")
def nearest_names(spark: SparkSession, d: str) -> DataFrame:
    """The three best known names of each asked one."""
    return N.nearest_names(*_names(spark, d), 3).select("query_id", "place", "entry_id", "score", "reasons")


@query(
    "jn11_lookup",
    f"""WITH {_NAMES}, {_SCORED},
    x AS (SELECT a.query_id, count(DISTINCT term) AS terms, min(entry_id) AS equal FROM a JOIN e ON query = name GROUP BY 1),
    y AS (SELECT query_id, max(CASE WHEN place = 1 THEN entry_id END) AS e1, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 2 THEN score END) AS s2,
        max(CASE WHEN place = 1 THEN tj END) AS t1, max(CASE WHEN place = 2 THEN tj END) AS t2, max(qj) AS qj FROM r WHERE place <= 2 GROUP BY 1),
    z AS (SELECT a.query_id, terms, equal, y.* EXCLUDE (query_id), round(s1 - s2, 6) <= 0.03 AS tied,
        round(CASE WHEN levenshtein(qj, t1) <= 4 THEN 1 - levenshtein(qj, t1)::DOUBLE / greatest(len(qj), len(t1)) ELSE 0 END
            - CASE WHEN levenshtein(qj, t2) <= 4 THEN 1 - levenshtein(qj, t2)::DOUBLE / greatest(len(qj), len(t2)) ELSE 0 END, 6) >= 0.08 AS lead
        FROM a LEFT JOIN x USING (query_id) LEFT JOIN y USING (query_id)),
    w AS (SELECT *, CASE WHEN terms > 1 THEN 'ambiguous_exact_collision' WHEN terms = 1 THEN 'exact_normalized_variant_match' WHEN e1 IS NULL THEN 'no_candidate_found'
        WHEN tied AND t1 = t2 THEN 'same_canonical_cluster' WHEN tied AND lead THEN 'canonical_tie_break' WHEN tied THEN 'ambiguous_top_candidates' ELSE 'fuzzy_match' END AS reason FROM z),
    v AS (SELECT query_id, reason, CASE WHEN reason IN ('ambiguous_exact_collision', 'no_candidate_found', 'ambiguous_top_candidates') THEN 'no_match' ELSE 'match' END AS status,
        CASE WHEN terms = 1 THEN equal ELSE e1 END AS found, CASE WHEN terms = 1 THEN 1.0::DOUBLE ELSE round(s1, 4) END AS s FROM w)
    SELECT query_id, status, CASE WHEN status = 'match' THEN found END AS entry_id, CASE WHEN status = 'match' THEN s ELSE 0.0::DOUBLE END AS score, reason,
        CASE WHEN status <> 'match' THEN 'none' WHEN s >= 0.93 THEN 'high' WHEN s >= 0.84 THEN 'medium' WHEN s >= 0.72 THEN 'low' ELSE 'none' END AS confidence FROM v""",
)
def lookup(spark: SparkSession, d: str) -> DataFrame:
    """One answer for each asked name."""
    return N.looked_up(*_names(spark, d))


#: Hosts and the hosts above them, as kinds and broader kinds.
_HOSTS = """h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages WHERE url IS NOT NULL),
    up AS (SELECT DISTINCT array_to_string(p[i:], '.') AS kind, array_to_string(p[j:], '.') AS broader, j - i AS steps
        FROM (SELECT string_split(host, '.') AS p FROM h WHERE host <> ''), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS j) WHERE i < j)"""


def _hosts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages with their hosts, and each host's next broader one."""
    pages = table(spark, d, "pages").where("url IS NOT NULL").select("page_id", "url", F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host")).where("host <> ''")
    parts = F.split("host", "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size("tails") - 1), lambda i: F.struct(F.get("tails", i - 1).alias("kind"), F.get("tails", i).alias("broader"))))
    edges = pages.select(tails.alias("tails")).distinct().where("size(tails) > 1").select(steps.alias("e")).select("e.kind", "e.broader").distinct()
    return pages, edges


@query("jn26_closure", f"WITH {_HOSTS} SELECT kind, broader, CAST(steps AS BIGINT) AS steps FROM up")
def host_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every host and all that are above it."""
    return H.closure(_hosts(spark, d)[1])


@query(
    "jn26_related_kinds",
    f"""WITH {_HOSTS}, x AS (SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages WHERE url IS NOT NULL) WHERE host <> '' GROUP BY 1),
    k AS (SELECT kind FROM up UNION SELECT broader FROM up),
    r AS (SELECT kind, broader AS other, 'broader' AS relation FROM up UNION ALL SELECT broader, kind, 'narrower' FROM up UNION ALL SELECT kind, kind, 'same' FROM k)
    SELECT relation, r.kind, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS pages FROM r JOIN x ON x.host = r.other WHERE r.kind IN (SELECT host FROM x) GROUP BY 1, 2""",
)
def related_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Of each host with pages: the hosts with pages that are the same, broader or narrower, and their pages."""
    pages, edges = _hosts(spark, d)
    counted = pages.groupBy("host").agg(F.count("*").alias("n"))
    met = H.related(counted.select(F.col("host").alias("kind")), counted.select(F.col("host").alias("other"), "n"), H.closure(edges))
    return met.groupBy("relation", "kind").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"))


@query(
    "prj28_narrowest_kind",
    f"""WITH {_HOSTS}, m AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS member, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS kind FROM pages WHERE url IS NOT NULL),
    d AS (SELECT kind, count(*) AS depth FROM up GROUP BY 1), r AS (
        SELECT member, m.kind, coalesce(depth, 0) AS depth, row_number() OVER (PARTITION BY member ORDER BY coalesce(depth, 0) DESC, m.kind DESC) AS o FROM m LEFT JOIN d USING (kind) WHERE m.kind <> '')
    SELECT member, kind, CAST(depth AS BIGINT) AS depth FROM r WHERE o = 1""",
)
def narrowest_kind(spark: SparkSession, d: str) -> DataFrame:
    """Of each path of pages: the narrowest of the hosts that have it."""
    pages, edges = _hosts(spark, d)
    members = pages.select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("member"), F.col("host").alias("kind")).distinct()
    return H.narrowest(members, H.closure(edges))


#: Words of the benchmark are the lexicon; words of conversations, and their first two words written as one, are to be mended.
_LEXICON = f"""l AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM benchmark),
    t AS (SELECT {_WORDS} AS w FROM conversations),
    q AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM t UNION ALL SELECT w[1] || w[2] FROM t WHERE len(w) > 1))"""


def _mended(words: str, out: str) -> str:
    return f"""{out}_c AS (
        SELECT x.word, y.word AS best, damerau_levenshtein(x.word, y.word) AS d FROM {words} x JOIN l y ON y.word[1] = x.word[1] AND ends_with(x.word, 's') = ends_with(y.word, 's') AND abs(len(x.word) - len(y.word)) <= 2
        WHERE len(x.word) >= 5 AND regexp_full_match(x.word, '[a-z]+') AND x.word NOT IN (SELECT word FROM l)
    ), {out}_o AS (SELECT word, min(best) AS best, min(d) AS d FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY d) AS o FROM {out}_c WHERE d <= 2) WHERE o = 1 GROUP BY word HAVING count(*) = 1),
    {out} AS (
        SELECT x.word, coalesce(CASE WHEN 1 - d::DOUBLE / greatest(len(x.word), len(best)) >= 0.72 THEN best END, x.word) AS best,
            CASE WHEN x.word IN (SELECT word FROM l) OR len(x.word) < 3 OR NOT regexp_full_match(x.word, '[a-z]+') THEN 1.0::DOUBLE
                ELSE coalesce(CASE WHEN 1 - d::DOUBLE / greatest(len(x.word), len(best)) >= 0.72 THEN round(1 - d::DOUBLE / greatest(len(x.word), len(best)), 2) END, 0.0) END AS nearness
        FROM {words} x LEFT JOIN {out}_o USING (word))"""


def _lexicon(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lexicon = table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    turns = table(spark, d, "conversations").select(T.words(F.col("text")).alias("w"))
    joined = turns.where("size(w) > 1").select(F.concat(F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("word"))
    return turns.select(F.explode("w").alias("word")).unionByName(joined).distinct(), lexicon


@query("fn15_mended_words", f"WITH {_LEXICON}, {_mended('q', 'm')} SELECT word, best, nearness FROM m")
def mended_words(spark: SparkSession, d: str) -> DataFrame:
    """Each word of the conversations as the benchmark's words mend it."""
    return S.mended(*_lexicon(spark, d), across=True)


@query(
    "fn15_parted_words",
    f"""WITH {_LEXICON}, c AS (
        SELECT word, i, word[:i] AS a, word[i + 1:] AS b FROM (SELECT word, unnest(range(3, len(word) - 2)) AS i FROM q WHERE len(word) >= 8 AND word NOT IN (SELECT word FROM l))
    ), s AS (SELECT a AS word FROM c UNION SELECT b FROM c), {_mended('s', 'm')},
    r AS (SELECT m.*, word IN (SELECT word FROM l) AS own FROM m WHERE best IN (SELECT word FROM l)),
    f AS (SELECT c.word, i, x.best || ' ' || y.best AS parts FROM c JOIN r x ON x.word = a JOIN r y ON y.word = b WHERE (x.own OR y.own) AND round((x.nearness + y.nearness) / 2, 6) >= 0.8)
    SELECT word, parts FROM f QUALIFY row_number() OVER (PARTITION BY word ORDER BY i) = 1""",
)
def parted_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the conversations that are two words of the benchmark, written as one."""
    return S.parted(*_lexicon(spark, d), across=True).where("size(parts) > 1").select("word", F.array_join("parts", " ").alias("parts"))


@query("fn7_word_overlap", f"""WITH t AS (SELECT conv_id, turn, list_slice({_WORDS}, 1, 12) AS nw FROM conversations),
    o AS (SELECT a.conv_id, a.turn, a.nw AS qw, b.nw AS nw FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, CASE WHEN len(qw) = 0 OR len(nw) = 0 THEN 0.0::DOUBLE ELSE round({_OVERLAP}, 6) END AS overlap FROM o""")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the heads (twelve words, as of a title) of a turn and of the next one cover each other."""
    heads = table(spark, d, "conversations").select("conv_id", "turn", F.slice(T.words(F.col("text")), 1, 12).alias("w"))
    after = heads.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next"))
    return heads.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.token_overlap(F.col("w"), F.col("next")), 6).alias("overlap"))


_UNKNOWN = f"""b AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY 1),
    t AS (SELECT DISTINCT conv_id, unnest({_WORDS}) AS word FROM conversations), u AS (SELECT * FROM t WHERE word NOT IN (SELECT word FROM b))"""


def _unknown(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), T.words(F.col("text")).alias("words"))
    return N.unexplained(asked, known), known


@query("flt33_unexplained_words", f"WITH {_UNKNOWN} SELECT conv_id AS query_id, word FROM u")
def unexplained_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of each conversation that the benchmark doesn't have."""
    return _unknown(spark, d)[0]


@query(
    "fn31_did_you_mean",
    f"""WITH {_UNKNOWN}, q AS (SELECT DISTINCT word AS a FROM u),
    p AS (SELECT a, word AS b, n, levenshtein(a, word) AS d FROM q JOIN b ON abs(len(a) - len(word)) <= 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, n DESC, b) AS place FROM p
        WHERE d <= CASE WHEN len(a) >= 10 AND len(b) >= 10 THEN 4 ELSE 3 END AND d <= floor(greatest(len(a), len(b)) * (1 - (0.6::DOUBLE - 0.25 - 0.03 - 0.04 - 0.06) / 0.75) + 1e-9))
    SELECT a AS word, place, b AS suggestion, CAST(d AS BIGINT) AS distance FROM r WHERE place <= 3""",
)
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    """For each word that nothing explains: the three nearest known ones."""
    words, known = _unknown(spark, d)
    return N.did_you_mean(words, known)
