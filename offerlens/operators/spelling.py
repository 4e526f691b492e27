"""Mending words by a lexicon: slips of a letter or two, and words written as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text as T

#: Letters from which a word is looked at, mended and parted; the least part; the least nearness of a word, and of two parts together.
READ_FROM, MENDED_FROM, PARTED_FROM, LEAST_PART = 3, 5, 8, 3
WORD_NEAR, PARTS_NEAR = 0.72, 0.8


def calm(word: Column) -> Column:
    """A word of letters with two of a letter that is repeated more often."""
    return F.when(word.rlike(r"^\p{L}+$"), F.regexp_replace(word, r"(.)\1{2,}", "$1$1")).otherwise(word)


def _swapped(word: Column) -> Column:
    """All words that one swap of neighbours gives."""
    places = F.when(F.length(word) > 1, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), F.substr(word, i + 2, F.length(word))))


def swap_distance(a: Column, b: Column, across: bool = False) -> Column:
    """Edits from a to b, a swap of neighbours being one, up to 2; null beyond. No letter is edited again after its swap; across: but two may swap across
    one that goes, and one may come between two that swapped (the unrestricted distance)."""
    places = F.when(F.length(a) > 1, F.sequence(F.lit(1), F.length(a) - 1)).otherwise(F.array().cast("array<int>"))
    letter = lambda w, i: F.substr(w, i, F.lit(1))

    def with_swap(i: Column, j: Column) -> Column:
        head = F.levenshtein(F.left(a, i - 1), F.left(b, j - 1), 1)
        tail = F.levenshtein(F.substr(a, i + 2, F.length(a)), F.substr(b, j + 2, F.length(b)), 1)
        turned = (j >= 1) & (letter(a, i) == letter(b, j + 1)) & (letter(a, i + 1) == letter(b, j)) & (letter(a, i) != letter(a, i + 1))
        return F.when(turned & (head >= 0) & (tail >= 0) & (head + tail <= 1), 1 + head + tail)

    one = F.array_min(F.flatten(F.transform(places, lambda i: F.transform(F.array(i - 1, i, i + 1), lambda j: with_swap(i, j)))))
    two = F.when(F.arrays_overlap(_swapped(a), _swapped(b)), 2)
    edits = F.levenshtein(a, b, 2)

    def crossed(long: Column, short: Column) -> Column:
        ends = lambda i: (F.left(long, i - 1) == F.left(short, i - 1)) & (F.substr(long, i + 3, F.length(long)) == F.substr(short, i + 2, F.length(short)))
        around = lambda i: (letter(long, i) == letter(short, i + 1)) & (letter(long, i + 2) == letter(short, i)) & ends(i)
        return (F.length(long) == F.length(short) + 1) & (F.length(short) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(short) - 1, F.lit(1))), around)

    plain = F.least(F.when(edits >= 0, edits), one, two)
    return F.least(plain, F.when(crossed(a, b) | crossed(b, a), 2)) if across else plain


def _cuts(word: Column) -> Column:
    """Keys that words with one first letter and one end (an s or not) share if they are two edits or swaps apart: what up to two deletions leave."""
    once = T.deletions(F.substr(word, F.lit(2), F.length(word)))
    twice = F.array_distinct(F.flatten(F.transform(once, T.deletions)))
    return F.transform(twice, lambda c: F.xxhash64(F.left(word, F.lit(1)), F.endswith(word, F.lit("s")), c))


def mended(words: DataFrame, lexicon: DataFrame, across: bool = False) -> DataFrame:
    """word, best and nearness of words(word) by lexicon(word), both distinct; across: see swap_distance.

    A word of the lexicon, a short one and one with other signs than letters stay (1.0). Of the lexicon's words with the same first letter, and
    an s at the end if the word has one, the one with the fewest edits is best, two at most; if two are, or it is too far, the word stays
    (0.0). Candidates share what is left after two deletions, so each word has a bounded number of keys.
    """
    known = words.join(lexicon.withColumn("known", F.lit(True)), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    as_is = F.col("known") | (F.length("word") < READ_FROM) | ~F.col("word").rlike(r"^\p{L}+$")
    open_ = known.where(~as_is & (F.length("word") >= MENDED_FROM)).select("word")
    keys = lambda rows, c: rows.select(F.col("word").alias(c), F.explode(_cuts(F.col("word"))).alias("key"))
    pairs = keys(open_, "a").join(keys(lexicon, "b"), "key").select("a", "b").distinct()
    near = pairs.withColumn("edits", swap_distance(F.col("a"), F.col("b"), across)).where("edits IS NOT NULL")
    best = near.groupBy("a").agg(F.min("edits").alias("least"), F.min(F.struct("edits", "b")).alias("first"), F.max(F.struct(-F.col("edits"), "b")).alias("last"))
    nearness = 1 - F.col("least") / F.greatest(F.length("a"), F.length("first.b"))
    sure = best.where(F.col("first.b") == F.col("last.b")).where(nearness >= WORD_NEAR).select(F.col("a").alias("word"), F.col("first.b").alias("best"), F.round(nearness, 2).alias("nearness"))
    return known.select("word", as_is.alias("as_is")).join(sure, "word", "left").select("word", F.coalesce("best", "word").alias("best"), F.when(F.col("as_is"), 1.0).otherwise(F.coalesce("nearness", F.lit(0.0))).alias("nearness"))


def parted(words: DataFrame, lexicon: DataFrame, across: bool = False) -> DataFrame:
    """word and parts (array) of words(word): two words of the lexicon that were written as one, the first such place, or the word itself; across: see swap_distance.

    One of the two must be a word of the lexicon as it is; the other may be mended if both are near enough together. All parts of all words
    are mended at once, as distinct words.
    """
    unknown = words.join(lexicon.select("word"), "word", "left_anti")
    cuts = unknown.where(F.length("word") >= PARTED_FROM).select("word", F.explode(F.sequence(F.lit(LEAST_PART), F.length("word") - LEAST_PART)).alias("at"))
    cuts = cuts.select("word", "at", F.left("word", F.col("at")).alias("left"), F.substr("word", F.col("at") + 1, F.length("word")).alias("right"))
    own = lexicon.select("word").withColumn("own", F.lit(True))
    side = lambda c: cuts.select(F.col(c).alias("word"))
    read = mended(side("left").unionByName(side("right")).distinct(), lexicon, across)
    read = read.join(own, "word", "left").join(own.select(F.col("word").alias("best"), F.col("own").alias("best_own")), "best", "left").where("best_own")
    of = lambda c: read.select(F.col("word").alias(c), F.col("best").alias(f"{c}_best"), F.coalesce("own", F.lit(False)).alias(f"{c}_own"), F.col("nearness").alias(f"{c}_near"))
    both = cuts.join(of("left"), "left").join(of("right"), "right")
    fits = (F.col("left_own") | F.col("right_own")) & (F.round((F.col("left_near") + F.col("right_near")) / 2, 6) >= PARTS_NEAR)
    found = both.where(fits).groupBy("word").agg(F.min(F.struct("at", F.array("left_best", "right_best").alias("parts")))["parts"].alias("parts"))
    return words.join(found, "word", "left").select("word", F.coalesce("parts", F.array("word")).alias("parts"))


def normalised(rows: DataFrame, lexicon: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """row_id and text of rows(row_id, text): aliases replaced as whole words (longest first), repeats of letters shortened, words parted, then mended.

    Work goes by distinct words. A row without words, or null, has an empty text.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    for source, target in sorted((aliases or {}).items(), key=lambda a: (-len(a[0]), a[0])):
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])\Q{source}\E(?![\p{{L}}\p{{N}}])", target)
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = rows.select("row_id", F.posexplode(words).alias("place", "raw")).withColumn("word", calm(F.col("raw")))
    vocabulary = placed.select("word").distinct()
    parts = parted(vocabulary, lexicon)
    single = parts.select(F.explode("parts").alias("word")).distinct()
    best = mended(single, lexicon).select(F.col("word").alias("part"), "best")
    whole = parts.select("word", F.posexplode("parts").alias("number", "part")).join(best, "part").groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "best"))), lambda p: p["best"]), " ").alias("new"))
    # A row's words come together again; a row is as long as its text.
    texts = placed.join(whole, "word").groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda p: p["new"]), " ").alias("text"))
    return rows.select("row_id").join(texts, "row_id", "left").select("row_id", F.coalesce("text", F.lit("")).alias("text"))
