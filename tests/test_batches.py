"""Bounded batches against a fold over all sets."""

import random

import pytest

from offerlens.operators.batches import batched


def fold(sets, most, total):
    out, batch, count, filled = {}, -1, 0, 0
    for key, size in sorted(sets):
        if batch < 0 or count == most or filled + (size or 0) > total:
            batch, count, filled = batch + 1, 0, 0
        count, filled = count + 1, filled + (size or 0)
        out[key] = batch
    return out


@pytest.mark.parametrize("seed,most,total,largest", [(1, 25, 250, 30), (2, 5, 40, 60), (3, 1, 10, 5), (4, 400, 10**9, 3), (5, 30, 10, 0)])
def test_batches_as_by_a_fold(spark, seed, most, total, largest):
    rng = random.Random(seed)
    sets = [(i * 3, rng.choice([rng.randint(0, largest), None])) for i in range(700)]
    df = spark.createDataFrame(sets, "key long, size long").selectExpr("key", "size", "'x' AS n").repartition(5)
    for partitions in ("1", "7", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = batched(df, "key", "size", most, total)
            assert got.columns == ["key", "size", "n", "batch"]
            assert {r.key: r.batch for r in got.collect()} == fold(sets, most, total)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_sets(spark):
    assert not batched(spark.createDataFrame([], "key long, size long"), "key", "size").count()
