"""Fuzzy lookup of names: candidates by shared segments, a ranked score, and the rules by which one answer is taken or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import text as T

#: The weights of a score, its bonuses, the least score that counts and those of the levels of confidence.
EDIT_WEIGHT, OVERLAP_WEIGHT = 0.75, 0.25
JOINED_BONUS, FAMILY_BONUS, SKELETON_BONUS, TERM_SKELETON_BONUS = 0.03, 0.04, 0.06, 0.05
LEAST, MEDIUM, HIGH = 0.72, 0.84, 0.93
#: Edits allowed between two names without their spaces, more where both have so many letters; kinds of names with a bonus.
EDITS, LONG_EDITS, LONG = 3, 4, 10
FAMILY = ("us_uk_spelling", "spelling_family")
#: Two best names this near are a tie; a term so much nearer the query breaks it.
TIE, TERM_LEAD = 0.03, 0.08
#: Digits of a score that count.
DIGITS = 6


def _limit(n: Column, m: Column, least: float) -> Column:
    """Edits that two strings of n and m letters may have to reach the score at all: the rest of it gives so much at most."""
    share = 1 - (least - OVERLAP_WEIGHT - JOINED_BONUS - FAMILY_BONUS - SKELETON_BONUS) / EDIT_WEIGHT
    allowed = F.when((n >= LONG) & (m >= LONG), LONG_EDITS).otherwise(EDITS)
    return F.least(allowed, F.floor(F.greatest(n, m) * F.lit(share) + 1e-9).cast("int"))


def _segments(length: Column, edits: Column) -> Column:
    """Where a string of so many letters is cut into edits + 1 parts, the longer ones last: (number, start from 0, size)."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    short = parts - length % parts
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(i.alias("i"), (i * base + F.greatest(F.lit(0), i - short)).alias("start"), F.when(i < short, base).otherwise(base + 1).alias("size")))


def _key(length: Column, edits: Column, i: Column, part: Column) -> Column:
    return F.xxhash64(length, edits, i, part)


def near_strings(asked: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """a of asked(a) and b of known(b), distinct strings, within the edits that a score of least allows; and distance.

    A known string is cut into one part more than edits are allowed, so that one of them is whole in any string so near; and it can
    only stand as many places off as edits on either side of it may have moved it. Both sides give keys of length,
    edits, number and part: a bounded number for each string, whatever the others are. Strings shorter than their parts' number meet by
    length alone; there are few of them.
    """
    near = F.sequence(F.greatest(F.col("n") - LONG_EDITS, F.lit(1)), F.col("n") + LONG_EDITS)
    whole = F.lit("")

    own = known.withColumn("n", F.length("b")).where("n > 0")
    ways = F.array_distinct(F.transform(F.filter(near, lambda m: F.abs(m - F.col("n")) <= _limit(m, F.col("n"), least)), lambda m: _limit(m, F.col("n"), least)))

    def cut(d: Column) -> Column:
        parts = F.transform(_segments(F.col("n"), d), lambda s: _key(F.col("n"), d, s["i"], F.substr(F.col("b"), s["start"] + 1, s["size"])))
        return F.when(d < F.col("n"), parts).otherwise(F.array(_key(F.col("n"), d, F.lit(-1), whole)))

    index = own.select("b", F.explode(F.flatten(F.transform(ways, cut))).alias("key"))

    def looked(m: Column) -> Column:
        d = _limit(m, F.col("n"), least)
        apart = F.col("n") - m

        def places(s: Column) -> Column:
            first = F.greatest(s["start"] - F.floor((d - apart) / 2).cast("int"), F.lit(0))
            last = F.least(s["start"] + F.floor((d + apart) / 2).cast("int"), F.col("n") - s["size"])
            starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda p: _key(m, d, s["i"], F.substr(F.col("a"), p + 1, s["size"])))

        parts = F.flatten(F.transform(_segments(m, d), places))
        return F.when(F.abs(apart) > d, F.array().cast("array<bigint>")).when(d < m, parts).otherwise(F.array(_key(m, d, F.lit(-1), whole)))

    keys = asked.withColumn("n", F.length("a")).where("n > 0").select("a", F.explode(F.array_distinct(F.flatten(F.transform(near, looked)))).alias("key"))
    met = keys.join(index, "key").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", LONG_EDITS)).where((F.col("distance") >= 0) & (F.col("distance") <= _limit(F.length("a"), F.length("b"), least)))


def nearest_names(asked: DataFrame, entries: DataFrame, k: int, least: float = LEAST) -> DataFrame:
    """The k best entries(entry_id, name, term, kind) for each of asked(query_id, query): their place, score and reasons.

    The score is 3/4 of the nearness in edits without spaces and 1/4 of the words' overlap; more for names that differ in spaces only, for
    spellings of one family and for equal consonants. Scores go by DIGITS digits; ties go to canonical names, then the smaller id. Names
    and queries are lower case with single spaces; empty ones and nulls take no part.
    """
    joined = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    q = asked.select("query_id", "query", joined("query").alias("a")).where("a <> ''")
    e = entries.select("entry_id", "name", "term", "kind", joined("name").alias("b")).where("b <> ''")
    pairs = near_strings(q.select("a").distinct(), e.select("b").distinct(), least)
    both = pairs.join(q, "a").join(e, "b")
    if least > EDIT_WEIGHT * T.WORD_NEAR + JOINED_BONUS + FAMILY_BONUS + SKELETON_BONUS:
        # Of two single words that are too far apart to overlap, no bonus makes up for it: such pairs are most, and need no score.
        single = ~F.contains("query", F.lit(" ")) & ~F.contains("name", F.lit(" "))
        both = both.where(~single | (1 - F.col("distance") / F.greatest(F.length("a"), F.length("b")) >= T.WORD_NEAR - 1e-9))
    skeleton = T.skeleton(F.col("a"))
    same = (F.col("a") == F.col("b")) & (F.col("query") != F.col("name"))
    family = F.col("kind").isin(*FAMILY)
    by_name = (skeleton != "") & (skeleton == T.skeleton(F.col("b")))
    by_term = (skeleton != "") & ~by_name & (skeleton == T.skeleton(joined("term")))
    score = EDIT_WEIGHT * (1 - F.col("distance") / F.greatest(F.length("a"), F.length("b"))) + OVERLAP_WEIGHT * T.token_overlap(F.split("query", " "), F.split("name", " "))
    for rule, bonus in ((same, JOINED_BONUS), (family, FAMILY_BONUS), (by_name, SKELETON_BONUS), (by_term, TERM_SKELETON_BONUS)):
        score = F.when(F.coalesce(rule, F.lit(False)), F.least(F.lit(1.0), score + bonus)).otherwise(score)
    named = {"fuzzy_match": F.lit(True), "joined_words_match": same, "spelling_family_match": family, "consonant_skeleton_match": by_name, "canonical_consonant_skeleton_match": by_term}
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in sorted(named.items())]))
    scored = both.select("query_id", "query", "entry_id", "name", "term", "kind", F.round(score, DIGITS).alias("score"), F.array_join(reasons, ",").alias("reasons")).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce(F.col("kind") != "exact_canonical", F.lit(True)), "entry_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").when(score >= LEAST, "low").otherwise("none")


def _nearness(a: Column, b: Column) -> Column:
    """1 less the share of edits between two strings, 0 beyond LONG_EDITS."""
    far = F.levenshtein(a, b, LONG_EDITS)
    return F.when(far >= 0, 1 - far / F.greatest(F.length(a), F.length(b), F.lit(1))).otherwise(0.0)


def looked_up(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """One answer for each of asked(query_id, query): status, entry_id, score, confidence and reason.

    An equal name wins if all that are equal are of one term. Otherwise the best near name wins, unless another term's is as near: then the
    term that is clearly nearer to the query, or none.
    """
    equal = asked.join(entries, asked["query"] == entries["name"]).groupBy("query_id").agg(F.count_distinct("term").alias("terms"), F.min(F.struct(F.coalesce(F.col("kind") != "exact_canonical", F.lit(True)), "entry_id"))["entry_id"].alias("equal"))
    best = nearest_names(asked, entries, 2)
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    of = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    two = best.groupBy("query_id").agg(*[of(p, c).alias(f"{c}_{p}") for p in (1, 2) for c in ("entry_id", "score", "term", "reasons")])
    rows = asked.select("query_id", "query").join(equal, "query_id", "left").join(two, "query_id", "left")
    tied = F.coalesce(F.round(F.col("score_1") - F.col("score_2"), DIGITS) <= TIE, F.lit(False))
    one_term = F.col("term_1") == F.col("term_2")
    lead = F.round(_nearness(bare(F.col("query")), bare(F.col("term_1"))) - _nearness(bare(F.col("query")), bare(F.col("term_2"))), DIGITS) >= TERM_LEAD
    cases = [
        (F.coalesce(F.col("query"), F.lit("")) == "", "no_match", "empty_query"),
        (F.col("terms") > 1, "no_match", "ambiguous_exact_collision"),
        (F.col("terms") == 1, "match", "exact_normalized_variant_match"),
        (F.col("entry_id_1").isNull(), "no_match", "no_candidate_found"),
        (tied & one_term, "match", "same_canonical_cluster"),
        (tied & lead, "match", "canonical_tie_break"),
        (tied, "no_match", "ambiguous_top_candidates"),
    ]
    status, reason = F.lit("match"), F.lit("fuzzy_match")
    for rule, s, r in reversed(cases):
        status, reason = F.when(rule, s).otherwise(status), F.when(rule, r).otherwise(reason)
    exact = F.coalesce(F.col("terms") == 1, F.lit(False))
    found = rows.select("query_id", status.alias("status"), F.when(exact, F.col("equal")).otherwise(F.col("entry_id_1")).alias("entry_id"), F.when(exact, 1.0).otherwise(F.round("score_1", 4)).alias("score"), reason.alias("reason"))
    hit = F.col("status") == "match"
    kept = found.select("query_id", "status", F.when(hit, F.col("entry_id")).alias("entry_id"), F.when(hit, F.col("score")).otherwise(0.0).alias("score"), "reason")
    return kept.withColumn("confidence", confidence(F.col("score")))


def unexplained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """query_id and word of asked(query_id, words) whose word no row of known(word) has; each once."""
    words = asked.select("query_id", F.explode("words").alias("word")).where("word <> ''").distinct()
    return words.join(known.select("word").distinct(), "word", "left_anti").select("query_id", "word")


#: Suggestions for a word, and the looser score that bounds their edits.
SUGGESTED, LOOSE = 3, 0.6


def did_you_mean(words: DataFrame, known: DataFrame, k: int = SUGGESTED) -> DataFrame:
    """The k names of known(word, n) nearest to each of words(word): by edits, then how often they occur, then name. place, suggestion, distance."""
    near = near_strings(words.select(F.col("word").alias("a")).where("a IS NOT NULL").distinct(), known.select(F.col("word").alias("b")).where("b IS NOT NULL").distinct(), LOOSE)
    counted = known.groupBy(F.col("word").alias("b")).agg(F.max("n").alias("n"))
    order = Window.partitionBy("a").orderBy("distance", F.desc("n"), "b")
    placed = near.where("a <> b").join(counted, "b").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.select(F.col("a").alias("word"), F.col("place").cast("bigint").alias("place"), F.col("b").alias("suggestion"), F.col("distance").cast("bigint").alias("distance"))
