"""The nightly memory: twice the same night, late nights, older states, the first sale night, streams that start again."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from offerlens.streaming import nights

DAY = lambda i: datetime.date(2026, 1, 1) + datetime.timedelta(days=i)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, nights.ROWS)


def plain(all_nights):
    """State and price records by a walk over the nights: {night: {key: (shop, price, currency, on_sale)}}."""
    state, prices = {}, {}
    days = sorted(all_nights)
    sale = next((d for d in days if any(r[3] is not None for r in all_nights[d].values())), None)
    for i, d in enumerate(days):
        for key, (shop, price, currency, on_sale) in all_nights[d].items():
            old = state.get(key)
            changed = old and (old["price"], old["currency"]) != (price, currency)
            if changed and on_sale and d == sale:
                prices[key] = []
            if not old or changed:
                prices.setdefault(key, []).append((d, price, currency))
            seen = [d] + (old["seen"] if old else [])
            state[key] = {"shop": shop, "price": price, "currency": currency, "first": old["first"] if old else d, "seen": seen, "since": d if not old or changed else old["since"]}
    out = {}
    for key, s in state.items():
        past = [d for d in days if d <= s["seen"][0]][::-1]
        bits = sum(1 << i for i, d in enumerate(past[: nights.KEPT]) if d in s["seen"])
        out[key] = (s["shop"], s["price"], s["currency"], s["first"], s["seen"][0], len(s["seen"]), s["since"], bits)
    return out, {(k, *p) for k, v in prices.items() for p in v}


def now(memory):
    return {r[0]: tuple(r)[1:] for r in memory.state().select(*nights.STATE, "seen_nights").collect()}, {tuple(r) for r in memory.prices().collect()}


def random_nights(seed, n):
    rng = random.Random(seed)
    return {DAY(i * rng.choice((1, 1, 2))  + 3 * i): {f"k{k}": (f"s{k % 3}", rng.choice((100, 100, 120, None)), "EUR", rng.choice((True, False)) if i > n // 2 else None) for k in range(12) if rng.random() < 0.7} for i in range(n)}


def flat(rows):
    return [(k, *r) for k, r in rows.items()]


def test_nights_in_any_order_and_twice(spark, tmp_path):
    all_nights = random_nights(1, 5)
    order = sorted(all_nights)
    rng = random.Random(2)
    rng.shuffle(order)
    memory = nights.Memory(spark, str(tmp_path))
    assert memory.state() is None and not memory.prices().count()
    first = rows_of(spark, [("k0", "s9", 7, "EUR", None), ("gone", "s1", 5, "EUR", None)])
    memory.remember(order[2], first)
    for d in order:
        memory.remember(d, rows_of(spark, [*flat(all_nights[d]), (None, "s", 1, "EUR", None)]).unionByName(rows_of(spark, flat(all_nights[d])[:2])))
    assert now(memory) == plain(all_nights)
    before = now(memory)
    memory.remember(order[0], rows_of(spark, flat(all_nights[order[0]])))
    assert now(memory) == before


def test_a_write_without_a_commit_counts_for_nothing(spark, tmp_path):
    memory = nights.Memory(spark, str(tmp_path))
    one = {DAY(0): {"a": ("s", 1, "EUR", None)}}
    memory.remember(DAY(0), rows_of(spark, flat(one[DAY(0)])))
    rows_of(spark, [("b", "s", 2, "EUR", None)]).write.parquet(f"{tmp_path}/rows/half")
    spark.range(1).write.parquet(f"{tmp_path}/state/half")
    assert now(memory) == plain(one)


def test_an_older_state_gets_the_new_column(spark):
    state = spark.createDataFrame([("all", DAY(0), DAY(2), 3), ("some", DAY(0), DAY(2), 2), ("one", DAY(2), DAY(2), 1)], "key string, first_seen date, last_seen date, nights_seen bigint")
    got = {r.key: r.seen_nights for r in nights.with_seen_nights(state, [DAY(0), DAY(1), DAY(2), DAY(9)]).collect()}
    assert got == {"all": 7, "some": 1, "one": 1}
    kept = nights.with_seen_nights(state.withColumn("seen_nights", F.lit(5)), [])
    assert {r.seen_nights for r in kept.collect()} == {5}


@pytest.mark.parametrize("restarts", [True, False])
def test_a_history_restarts_on_the_first_sale_night(spark, tmp_path, restarts):
    memory = nights.Memory(spark, str(tmp_path))
    memory.remember(DAY(0), rows_of(spark, [("sale", "s", 100, "EUR", None if restarts else False), ("usual", "s", 100, "EUR", None), ("same", "s", 80, "EUR", None)]))
    memory.remember(DAY(1), rows_of(spark, [("sale", "s", 80, "EUR", True), ("usual", "s", 90, "EUR", False), ("same", "s", 80, "EUR", True)]))
    want = {("sale", DAY(1), 80, "EUR"), ("usual", DAY(0), 100, "EUR"), ("usual", DAY(1), 90, "EUR"), ("same", DAY(0), 80, "EUR")}
    assert now(memory)[1] == (want if restarts else want | {("sale", DAY(0), 100, "EUR")})
    # Not on the nights after it.
    memory.remember(DAY(2), rows_of(spark, [("usual", "s", 70, "EUR", True)]))
    assert ("usual", DAY(0), 100, "EUR") in now(memory)[1]


def test_a_stream_that_starts_again_takes_no_batch_twice(spark, tmp_path):
    all_nights = random_nights(5, 3)
    source, memory = f"{tmp_path}/feed", nights.Memory(spark, f"{tmp_path}/memory")
    schema = nights.ROWS + ", night date"

    def arrive(day):
        spark.createDataFrame([(*r, day) for r in flat(all_nights[day])], schema).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(memory.taking("feed")).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()

    days = sorted(all_nights)
    arrive(days[0])
    arrive(days[2])
    run(f"{tmp_path}/c1")
    arrive(days[1])
    run(f"{tmp_path}/c1")
    assert now(memory) == plain(all_nights)
    done = memory.commits().count()
    run(f"{tmp_path}/c2")  # the stream's own notes are lost: the memory's still say which batches were taken
    assert memory.commits().count() == done and now(memory) == plain(all_nights)
