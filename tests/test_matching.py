"""Pairs of rows by their word sets, against plain versions, with large classes of equal rows."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from offerlens.operators import matching as M


def test_close_rows_as_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x", "y", None]), sorted(set(rng.choices("abcdef", k=rng.randint(1, 5))))) for i in range(300)] + [(300, "x", None)]
    pairs = M.close_rows(spark.createDataFrame(rows, "id long, kind string, words array<string>"), "id", ["kind"])
    want = [(a, b) for (a, k, x), (b, l, y) in combinations(rows[:-1], 2) if k == l and k and len({*x} & {*y}) >= min(len(x), len(y), 3)]
    assert sorted(map(tuple, pairs.collect())) == sorted(want)


def test_many_equal_rows_are_few_classes(spark):
    """What is compared grows with the distinct sets, not with the pairs of rows; all pairs of rows still come out."""
    rows = spark.range(3_000).select("id", F.lit("x").alias("kind"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))).alias("words"))
    own = M.blocks(rows, "id", ["kind"])
    assert own.count() == 4 and own.agg(F.max(F.size("ids"))).first()[0] == M.BLOCK
    pairs = M.block_pairs(own, ["kind"], "x", "y")
    assert pairs.count() <= 16
    assert M.row_pairs(pairs, "x", "y").count() == 3_000 * 2_999 // 2
    assert M.close_rows(rows, "id", ["kind"]).count() == 2 * (1_500 * 1_499 // 2)


def test_pairs_of_two_blocks_are_not_held_at_once(spark):
    """Generated code holds all rows that it makes of one row that it reads; both blocks exploded by it were a million pairs in memory."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ids = F.sequence(F.col("id"), F.col("id") + M.BLOCK - 1)
        pairs = spark.range(1).select(ids.alias("ids_x"), ids.alias("ids_y"))
        found = M.row_pairs(pairs.repartition(2), "x", "y")
        assert found.count() == M.BLOCK * (M.BLOCK - 1) // 2
        made = [line.strip(" :+-") for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in line]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(made) == 2 and sum(line.startswith("*") for line in made) == 1


def test_close_rows_of_classes_with_many_blocks(spark, monkeypatch):
    """Classes of several blocks, one of them with all words of another, ids that are in both or twice in one, and rows without an id, words or kind."""
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = [(i, k, w) for k in "xy" for w, ids in ((["a", "b"], range(100)), (["a"], range(90, 130)), (["c"], range(50)), (["b", "c", "d", "e"], range(120, 140))) for i in ids]
    rows += [(7, "x", ["a", "b"]), (95, "x", ["a", "b"]), (None, "x", ["a"]), (8, "x", None), (9, None, ["a"]), (10, None, ["a"])]
    pairs = M.close_rows(spark.createDataFrame(rows, "id long, kind string, words array<string>"), "id", ["kind"])
    of = {k: [(i, {*w}) for i, l, w in rows if l == k and i is not None and w] for k in "xy"}
    want = Counter((a, b) for k in "xy" for a, x in of[k] for b, y in of[k] if a < b and len(x & y) >= min(len(x), len(y), 3))
    assert Counter(map(tuple, pairs.collect())) == want


def test_blocks_of_one_class_are_paired_by_many_tasks(spark):
    """40 blocks of equal rows: their numbers are dealt before their ids are fetched. Before, one task had all pairs of blocks, with their ids."""
    rows = spark.range(40 * M.BLOCK).select("id", F.lit("x").alias("kind"), F.array(F.lit("a")).alias("words"))
    plan = M.close_rows(rows, "id", ["kind"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert sum("block_x" in line for line in joins) == 1 and sum("block_y" in line for line in joins) == 1


def test_near_numbers_as_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y"]), rng.choice([-250, -200, 0, 0, 1, 199, 200, 201, 400, rng.randint(-999, 999), None])) for i in range(400)]
    pairs = M.near_numbers(spark.createDataFrame(rows, "id long, kind string, v long"), "id", "v", ["kind"], 200)
    want = [(a, b) for (a, k, x), (b, l, y) in combinations(rows, 2) if k == l and x is not None and y is not None and abs(x - y) <= 200]
    assert sorted(map(tuple, pairs.collect())) == sorted(want)


def test_equal_numbers_are_dealt_over_tasks(spark):
    """5,000 equal numbers: no task makes more than two blocks' pairs at once, and no task has most of them."""
    rows = spark.range(5_000).select("id", F.lit("x").alias("kind"), F.lit(7).cast("bigint").alias("v"))
    made = M.near_numbers(rows, "id", "v", ["kind"], 200).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 5_000 * 4_999 // 2 and max(r["count"] for r in made) < 5_000 * 4_999 // 4


def test_rows_that_carry_all_words(spark):
    rng = random.Random(4)
    rows = [(i, w) for i in range(200) for w in set(rng.choices("abcdef", k=4))]
    asked = [(i, rng.choices("abcdefg", k=rng.randint(0, 3))) for i in range(60)] + [(60, ["a", None])]
    own = {i: {w for j, w in rows if j == i} for i in range(200)}
    got = M.carrying_all(spark.createDataFrame(rows, "row_id long, word string"), spark.createDataFrame(asked, "query_id long, words array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted((q, i) for q, w in asked if w for i in own if {*w} <= own[i])


def test_frequent_words_are_not_counted_by_query_and_row(spark):
    """Before, each query and each row of any of its words was a group of an aggregate: here 50 x 4,000, with 50 x 5 answers."""
    index = spark.range(4_000).select(F.col("id").alias("row_id"), F.explode(F.when(F.col("id") < 5, F.array(F.lit("often"), F.lit("rare"))).otherwise(F.array(F.lit("often")))).alias("word"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit("often"), F.lit("rare")).alias("words"))
    found = M.carrying_all(index, asked)
    assert found.count() == 250
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [query_id" in line and "row_id" in line.split("]")[0]]
