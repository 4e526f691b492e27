"""URL filtering by host and path rules, then by gradient-boosted trees on lexical features.

Everything runs in the JVM: built-in functions for the parsing and the features, Spark ML for the trees.

Labelled URLs. A URL is labelled 1 where a part of its host between dots and hyphens is a word of BAD_WORDS, else 0. The
trees see only lexical features, never those words, and give a probability for every URL.

Cases. A null URL, or one without "://", has an empty host and path; it fits no rule and its features are those of the
empty string. Repeated rows are judged each. Extra columns are ignored. Where the labelled URLs hold one class only (an
empty table, too), the method allows every URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import ASCII_LOWER, ASCII_UPPER, only

#: Words of hosts that carry adverts, tracking, betting, spam, adult or counterfeit offers.
BAD_WORDS = (
    "ad", "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "crack", "escort", "farm", "gambling", "hack", "loan",
    "malware", "nude", "phish", "phishing", "pill", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track",
    "tracker", "viagra", "warez", "xxx",
)
#: Rows of the bounded sample that the trees are fitted on.
SAMPLE_ROWS = 40_000
#: Cells of the suffix statistics: their table has this many rows at most, whatever the number of hosts.
SUFFIX_CELLS = 4_096
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule, else null. rules: pairs (host and path such as "net/de/", verdict)."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda sum_, c: sum_ - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "fragment", "vowel_ratio", "suffix2", "suffix3")


def _lexical(df: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("__url", F.lit("")), F.col("__host"), F.col("__path")
    count = lambda text, pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    cell = lambda n: F.pmod(F.xxhash64(F.substring_index(host, ".", -n), F.lit(n)), F.lit(SUFFIX_CELLS)).cast("int")
    n = F.greatest(F.length(url), F.lit(1))
    return df.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": count(path, "/"),
            "labels": count(host, r"\."),
            "digit_ratio": count(url, "[0-9]") / n,
            "host_digits": count(host, "[0-9]"),
            "hyphens": count(host, "-"),
            "entropy": _entropy(url),
            "host_entropy": _entropy(host),
            "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "query_length": F.length(query).cast("double"),
            "fragment": url.contains("#").cast("double"),
            "vowel_ratio": count(host, "[aeiou]") / F.greatest(F.length(host), F.lit(1)),
            "__cell2": cell(2),
            "__cell3": cell(3),
            "__label": F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, BAD_WORDS))).cast("int"),
            "__fold": F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(2)),
        }
    )


def _with_suffixes(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds the share of label 1 in the suffix's cell. stats has at most 2 * SUFFIX_CELLS rows."""
    for n in (2, 3):
        of = stats.where(F.col("n") == n).select(F.col("cell").alias(f"__cell{n}"), F.col("share").alias(f"suffix{n}"))
        df = df.join(F.broadcast(of), f"__cell{n}", "left")
    return df.fillna(0.0, ["suffix2", "suffix3"])


def _suffix_stats(df: DataFrame) -> DataFrame:
    """Smoothed shares of label 1 by hashed host suffix, over all rows of fold 0; the trees learn from fold 1."""
    cells = df.where("__fold = 0").select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"__cell{n}").alias("cell")) for n in (2, 3)])).alias("c"), "__label")
    return cells.groupBy("c.n", "c.cell").agg(((F.sum("__label") + 0.1) / (F.count("*") + 1)).alias("share"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), *, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability of block, for every row of pages(page_id, url)."""
    host, path = host_and_path(F.col("url"))
    base = only(pages, "page_id", "url").withColumns({"__host": host, "__path": path}).withColumnRenamed("url", "__url")
    rows = _lexical(base)
    sizes = {r["__label"]: r["n"] for r in rows.where("__fold = 1").groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) == 2:
        featured = _with_suffixes(rows, _suffix_stats(rows))
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="__features", handleInvalid="keep").transform(featured)
        # Each class gets half of the sample; a row is in it by its hash, on any machine alike.
        share = F.when(F.col("__label") == 1, min(1.0, sample_rows / 2 / sizes[1])).otherwise(min(1.0, sample_rows / 2 / sizes[0]))
        weight = F.when(F.col("__label") == 1, 1.0 / min(sizes[1], sample_rows / 2)).otherwise(1.0 / min(sizes[0], sample_rows / 2))
        picked = F.pmod(F.xxhash64("page_id", "__url", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000
        train = assembled.where((F.col("__fold") == 1) & picked).select("__features", F.col("__label").cast("double").alias("__y"), (weight * sample_rows / 2).alias("__w"))
        model = GBTClassifier(featuresCol="__features", labelCol="__y", weightCol="__w", maxIter=12, maxDepth=4, stepSize=0.3, seed=seed).fit(train)
        rows = model.transform(assembled).withColumn("probability", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("probability", F.lit(0.0))
    rule = rule_of(F.col("__host"), F.col("__path"), rules)
    by_rule = F.lit(None).cast("string")
    for text, verdict in rules:
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    by_method = F.when(F.col("probability") >= THRESHOLD, "block").otherwise("allow")
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), "probability").withColumn("verdict", F.coalesce(by_rule, by_method)).select("page_id", "host", "path", "rule", "verdict", "probability")
