"""The log of searches against a sequential fold, over days, batches, restarts and retention."""

import collections
import json
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from offerlens.session import shared_folder
from offerlens.streaming.search_log import SearchLog, fitting

START = datetime(2024, 5, 1)


def plain(rows, used, most):
    """Line by line, by time and text."""
    used, kept = collections.Counter(used), []
    for ts, line in sorted(rows):
        size = len(line.encode()) + 1
        if used[ts.date()] + size <= most:
            used[ts.date()] += size
            kept.append((ts, line))
    return collections.Counter(kept)


def test_fitting_lines_as_one_by_one(spark):
    rng = random.Random(3)
    for most, spread in ((900, 86_000), (2_500, 40), (50, 5), (4, 86_000), (10**6, 86_000)):
        rows = [(START + timedelta(days=rng.randint(0, 3), seconds=rng.randint(0, spread), milliseconds=rng.choice([0, 0, 5])), rng.choice("aβ") * rng.choice([1, 3, 8, 40, 41, 90])) for _ in range(600)]
        rows += rows[:80] * 3
        used = {date(2024, 5, 2): most // 2, date(2024, 5, 3): most}
        lines = spark.createDataFrame(rows, "ts timestamp, line string").withColumn("day", F.to_date("ts")).repartition(5)
        got = collections.Counter()
        for r in fitting(lines, spark.createDataFrame(list(used.items()), "day date, used bigint"), most).collect():
            got[r["ts"], r["line"]] += r["n"]
        assert got == plain(rows, used, most), most


def logged(log):
    return sorted((r["day"], r["q"]) for r in log.read().collect())


def test_days_restarts_and_retention(spark):
    log = SearchLog(spark, f"{shared_folder(spark)}/searches", most_bytes=60, keep_days=2)
    frame = lambda *rows: spark.createDataFrame(rows, "ts timestamp, q string")
    at = lambda day, hour=1: datetime(2024, 5, day, hour)
    log.record(frame(), 0)
    assert logged(log) == [] and not log.prune(date(2024, 5, 1))
    one = frame((at(1), "  red   shoes\n"), (at(1, 2), None), (None, "x"), (at(1, 3), " \t"), (at(2), 'say "yes" é'), (at(2), "x" * 500))
    log.record(one, 1)
    want = [(date(2024, 5, 1), "red shoes"), (date(2024, 5, 2), 'say "yes" é')]
    assert logged(log) == want
    log.record(one, 1)  # again: nothing twice
    assert logged(log) == want
    # The second day has room for 39 bytes more: 26 and 12, but not 27 before them.
    two = frame((at(2, 5), "b" * 19), (at(2, 6), "c" * 18), (at(2, 7), "dddd"), (at(2, 8), "e"), (at(3), "f"))
    left = 60 - len(json.dumps({"q": 'say "yes" é'}, ensure_ascii=False).encode()) - 1
    log.record(two, 2)
    fit = plain([(at(2, 5 + i), json.dumps({"q": q}, separators=(",", ":"))) for i, q in enumerate(["b" * 19, "c" * 18, "dddd", "e"])], {date(2024, 5, 2): 60 - left - 0}, 60)
    want += [(date(2024, 5, 2), json.loads(line)["q"]) for _, line in fit] + [(date(2024, 5, 3), "f")]
    assert logged(log) == sorted(want)
    log.record(frame((at(4), "g"), (at(1), "too old")), 3)  # the first day goes, and isn't begun again
    assert logged(log) == sorted([*want[1:], (date(2024, 5, 4), "g")])


def test_a_stream_that_starts_again(spark):
    where = shared_folder(spark)
    rows = [(START + timedelta(hours=i), f"search {i % 7}") for i in range(60)]
    log = SearchLog(spark, f"{where}/followed", most_bytes=200)
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, "ts timestamp, q string").coalesce(1).write.mode("append").parquet(f"{where}/stream-in")
        log.follow(spark.readStream.schema("ts timestamp, q string").parquet(f"{where}/stream-in"), f"{where}/stream-state")
    log.follow(spark.readStream.schema("ts timestamp, q string").parquet(f"{where}/stream-in"), f"{where}/stream-state")
    want = plain([(ts, json.dumps({"q": q}, separators=(",", ":"))) for ts, q in rows], {}, 200)
    assert logged(log) == sorted((ts.date(), json.loads(line)["q"]) for ts, line in want.elements()) and len(want) < len(rows)
