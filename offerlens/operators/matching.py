"""Joins on words and sets: postings, similarity, changes between periods, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import text as T


def postings(rows: DataFrame, row_id: str, words) -> DataFrame:
    """The inverted index: a row for each distinct word of each row."""
    return rows.select(F.col(row_id).alias("row_id"), F.explode(F.array_distinct(words)).alias("word"))


def near_words(words: DataFrame, edits: int) -> DataFrame:
    """Pairs a < b of distinct words(word) that share what is left after so many deletions at most: all that are as many edits apart, and some others.

    A string of n letters is left of n + 1 places times the alphabet's letters words at most, for each deletion.
    """
    cuts = words.select("word", F.col("word").alias("cut"))
    for _ in range(edits):
        cuts = cuts.select("word", F.explode(T.deletions(F.col("cut"))).alias("cut")).distinct()
    return cuts.withColumnRenamed("word", "a").join(cuts.withColumnRenamed("word", "b"), "cut").where("a < b").select("a", "b").distinct()


#: Queries that are sent to every task; more go by shuffle.
FEW_QUERIES = 100_000


def carrying_all(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows that carry every word of a query: asked(query_id, words).

    Queries with the same words are one; it meets the rows of its rarest word, and what else it needs is looked up in the row's own words. A row's words come
    together in a stated number of tasks, so none holds more than its part of the rows, and nothing is counted by query and row.
    """
    wanted = asked.select("query_id", F.array_sort(F.array_distinct("words")).alias("needed")).distinct()
    each = wanted.select("needed").distinct().select("needed", F.explode("needed").alias("word"))
    counted = index.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    first = each.join(counted, "word", "left").groupBy("needed").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    rows = index.repartition(16 * index.sparkSession.sparkContext.defaultParallelism, "row_id").groupBy("row_id").agg(F.collect_set("word").alias("own"))
    queries = blocks(wanted, "query_id", [], "needed").join(first, "needed")
    if wanted.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:  # else Spark may send the rows around, which it takes for the smaller side
        queries = F.broadcast(queries)
    met = rows.select("row_id", "own", F.explode("own").alias("word")).join(queries, "word").where(F.forall("needed", lambda w: F.array_contains("own", w)))
    return met.select(F.explode("ids").alias("query_id"), "row_id")


#: Sets of so many words at most are met by three shared rare words, larger ones by one.
SHORT_SET = 20


def word_sets(index: DataFrame) -> DataFrame:
    """Each row of an index and its word set, the rarest first and of equally rare ones in order: row_id, words."""
    frequency = index.groupBy("word").agg(F.count("*").alias("f"))
    sets = index.join(frequency, "word").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("own"))
    return sets.select("row_id", F.transform("own", lambda x: x["word"]).alias("words"))


def similar_sets(index: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of distinct word sets, by their least rows, with a Jaccard similarity of percent / 100 or more; n_a and n_b rows have them.

    Equal sets are one class first. Two similar sets of n words or more share l words among the rarest n - ceil(n * percent /
    100) + l of each; so they meet by the hashes of l such words: three while the smaller set is short, one beyond. Only ids and sizes
    go through that join, and sizes that can't be similar are parted there.
    """
    classes = word_sets(index).groupBy("words").agg(F.min("row_id").alias("id"), F.count("*").alias("n_rows")).withColumn("n", F.size("words"))
    together = max(1, min(3, -(-percent // max(1, 100 - percent))))
    least = lambda n: F.ceil(n * F.lit(percent) / 100).cast("int")
    level = lambda n: F.when(n <= SHORT_SET, together).otherwise(1)

    def keys(l: int):  # noqa: E741
        rare = F.slice("words", F.lit(1), F.col("n") - least(F.col("n")) + l)
        places = F.sequence(F.lit(0), F.size(rare) - 1)
        chosen = F.transform(places, lambda i: F.struct(i.alias("last"), F.xxhash64(F.lit(l), rare[i]).alias("h")))

        def longer(c):
            return F.transform(F.filter(places, lambda i: i > c["last"]), lambda i: F.struct(i.alias("last"), F.xxhash64(c["h"], rare[i]).alias("h")))

        for _ in range(l - 1):
            chosen = F.flatten(F.transform(chosen, longer))
        return F.transform(chosen, lambda c: c["h"])

    levels = F.array_distinct(F.array(level(F.col("n")), level(least(F.col("n")))))
    own = F.flatten(F.transform(levels, lambda l: F.when(l == 1, keys(1)).otherwise(keys(together))))  # noqa: E741
    keyed = classes.where(F.col("n") * (100 - percent) >= percent).select("id", "n", F.explode(F.array_distinct(own)).alias("key"))
    a, b = keyed.select(F.col("id").alias("a"), F.col("n").alias("size_a"), "key"), keyed.select(F.col("id").alias("b"), F.col("n").alias("size_b"), "key")
    fits = F.least("size_a", "size_b") * 100 >= percent * F.greatest("size_a", "size_b")
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    of = lambda c: classes.select(F.col("id").alias(c), F.col("words").alias(f"words_{c}"), F.col("n_rows").alias(f"n_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("words_a", "words_b")))
    both = both.withColumn("together", F.size("words_a") + F.size("words_b") - F.col("shared")).where(100 * F.col("shared") >= percent * F.col("together"))
    return both.select("a", "b", F.col("shared").cast("bigint").alias("shared"), F.col("together").cast("bigint").alias("together"), "n_a", "n_b")


#: Ids of one block of equal rows.
BLOCK = 1024


def blocks(rows: DataFrame, row_id: str, by: list[str], words: str = "words") -> DataFrame:
    """Rows with equal words (sorted sets) and columns by, once for each BLOCK of their ids: by, words, ids (in order)."""
    return _numbered_blocks(rows, row_id, by, words).drop("block")


def _numbered_blocks(rows: DataFrame, row_id: str, by: list[str], words: str = "words") -> DataFrame:
    """Blocks, and their places (from 0) among those with the same words and columns by."""
    number = F.row_number().over(Window.partitionBy(*by, words).orderBy(row_id)) - 1
    placed = rows.where(F.col(row_id).isNotNull()).select(*by, words, row_id, F.floor(number / BLOCK).alias("block"))
    return placed.groupBy(*by, words, "block").agg(F.array_sort(F.collect_list(row_id)).alias("ids"))


def block_pairs(blocks: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Blocks with the same columns by, whose rows may make pairs a < b: by, words and ids of both, as x, y, ids_x, ids_y."""
    of = lambda c: blocks.select(*by, F.col("words").alias(c), F.col("ids").alias(f"ids_{c}"))
    return of(x).join(of(y), by).where(_may_pair(x, y))


def _may_pair(x: str, y: str) -> Column:
    return F.get(f"ids_{x}", F.lit(0)) < F.element_at(f"ids_{y}", -1)


def row_pairs(pairs: DataFrame, x: str, y: str, *columns: str) -> DataFrame:
    """Pairs a < b of the rows of paired blocks, and columns that hold for all rows of the two; nothing is held but the two lists of ids and the pairs of one a.

    Generated code holds all rows that it makes of one row that it reads, so two explosions in one stage would hold all pairs of the two blocks. A filter of
    an array isn't generated: the rows of one block come from it one at a time, and only the other block is exploded by generated code.
    """
    first = pairs.select(*columns, f"ids_{y}", F.explode(F.filter(f"ids_{x}", lambda a: a < F.element_at(f"ids_{y}", -1))).alias("a"))
    return first.select(*columns, "a", F.explode(f"ids_{y}").alias("b")).where("a < b").select("a", "b", *columns)


def _lists(words: Column, n: int) -> Column:
    """All lists of n of a list's words, in its order."""
    places = F.sequence(F.lit(1), F.size(words))
    chosen = F.transform(places, lambda i: F.struct(i.alias("last"), F.array(F.get(words, i - 1)).alias("key")))

    def longer(c):
        return F.transform(F.filter(places, lambda i: i > c["last"]), lambda i: F.struct(i.alias("last"), F.concat(c["key"], F.array(F.get(words, i - 1))).alias("key")))

    for _ in range(n - 1):
        chosen = F.flatten(F.transform(chosen, longer))
    return F.transform(chosen, lambda c: c["key"])


def close_rows(rows: DataFrame, row_id: str, by: list[str], enough: int = 3) -> DataFrame:
    """Pairs a < b of rows(row_id, by, words) with equal columns by that share `enough` words, or all of the smaller set; words: sorted sets, not empty.

    Equal sets are one class. A set of n < enough words meets by all of them those sets that hold them; larger ones meet by `enough` shared words, and
    count at the first such. So what meets is an answer: the joins grow with what is found. Two classes are paired by the numbers of their blocks, which
    are dealt over tasks before ids are fetched, so a class of very many rows isn't one task's; the rows are paired last, in blocks that are dealt evenly.
    """
    rows = rows.where(F.col("words").isNotNull() & F.col(row_id).isNotNull()).select(row_id, *by, "words")
    classes = rows.groupBy(*by, "words").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    few = F.size("words") < enough
    parts = F.flatten(F.array(*(_lists(F.col("words"), n) for n in range(1, enough + 1))))
    some = classes.select(*by, F.col("words").alias("y"), F.col("n").alias("n_y"), F.explode(parts).alias("key"))
    asked = F.when(few, F.array("words")).otherwise(_lists(F.col("words"), enough))
    met = classes.select(*by, F.col("words").alias("x"), F.col("n").alias("n_x"), F.explode(asked).alias("key")).join(some, [*by, "key"])
    few = F.size("x") < enough
    met = met.where(few | (F.slice(F.array_intersect("x", "y"), 1, enough) == F.col("key")))
    pair = lambda p, q: F.struct(F.col(p).alias("x"), F.col(f"n_{p}").alias("n_x"), F.col(q).alias("y"), F.col(f"n_{q}").alias("n_y"))
    found = met.select(*by, F.inline(F.when(few & (F.col("x") != F.col("y")), F.array(pair("x", "y"), pair("y", "x"))).otherwise(F.array(pair("x", "y")))))
    tasks = 16 * rows.sparkSession.sparkContext.defaultParallelism
    placed = found.select(*by, "x", "y", "n_y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_x") - 1)).alias("block_x")).repartition(tasks, *by, "x", "block_x")
    first = F.when(F.col("x") == F.col("y"), F.col("block_x")).otherwise(0)
    placed = placed.select(*by, "x", "block_x", "y", F.explode(F.sequence(first, F.col("n_y") - 1)).alias("block_y"))
    own = _numbered_blocks(rows, row_id, by)
    of = lambda c: own.select(*by, F.col("words").alias(c), F.col("block").alias(f"block_{c}"), F.col("ids").alias(f"ids_{c}"))
    paired = placed.join(of("x"), [*by, "x", "block_x"]).join(of("y"), [*by, "y", "block_y"]).where(_may_pair("x", "y")).select("ids_x", "ids_y")
    return row_pairs(_dealt(paired), "x", "y")


def _dealt(paired: DataFrame) -> DataFrame:
    """Paired blocks, dealt evenly: they are few bytes of which many rows come, so their number of tasks can't follow from their size."""
    return paired.repartition(16 * paired.sparkSession.sparkContext.defaultParallelism)


def near_numbers(rows: DataFrame, row_id: str, value: str, by: list[str], within: int) -> DataFrame:
    """Pairs a < b of rows(row_id, value, by) with equal columns by whose whole numbers are at most `within` apart.

    Numbers are cut into cells as wide; a row meets the later ones of its own cell and those of the next. Cells are parted into blocks in order, which are
    dealt evenly, so neither a full cell nor equal numbers make one task's work.
    """
    placed = rows.where(F.col(row_id).isNotNull() & F.col(value).isNotNull())
    placed = placed.select(*by, F.struct(F.col(value).alias("v"), F.col(row_id).alias("id")).alias("row"), F.floor(F.col(value) / within).alias("cell"))
    own = blocks(placed, "row", by, "cell")
    x = own.select(*by, F.col("ids").alias("ids_x"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    y = own.select(*by, F.col("ids").alias("ids_y"), "cell")
    near = lambda first, last: last["v"] - first["v"] <= within
    paired = x.join(y, [*by, "cell"]).where(_may_pair("x", "y") & near(F.element_at("ids_x", -1), F.get("ids_y", F.lit(0))))
    met = row_pairs(_dealt(paired.select("ids_x", "ids_y")), "x", "y").where(near(F.col("a"), F.col("b")) & (F.col("a.id") != F.col("b.id")))
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows (n) of each key in two periods: new, gone, shrunk below a half, or held."""
    both = before.select(key, F.col("n").alias("n_before")).join(after.select(key, F.col("n").alias("n_after")), key, "full")
    status = F.when(F.col("n_before").isNull(), "new").when(F.col("n_after").isNull(), "gone").when(2 * F.col("n_after") < F.col("n_before"), "shrunk").otherwise("held")
    return both.select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), status.alias("status"))


def supports(rows: DataFrame, mask: str, bits: int) -> DataFrame:
    """How many rows hold each set of bits or more: the masks are counted first, then the lattice of at most 2**bits counts."""
    counts = rows.groupBy(mask).agg(F.count("*").alias("n"))
    subsets = F.explode(F.filter(F.sequence(F.lit(1), F.lit(2**bits - 1)), lambda s: F.col(mask).bitwiseAND(s) == s))
    return counts.select(subsets.alias("subset"), "n").groupBy("subset").agg(F.sum("n").alias("support"))
