"""Price notes there and back."""

import datetime
import random

from offerlens.sources import notes

DAY = lambda i: datetime.date(2026, 1, 1) + datetime.timedelta(days=i)


def test_there_and_back(spark):
    rng = random.Random(1)
    rows = [(f"k{k}", DAY(i), rng.choice([100, 100, 100, 250, None, 99])) for k in range(30) for i in range(60) if rng.random() < 0.7]
    rows += [("k0", DAY(0), 5), ("old", datetime.date(1969, 12, 30), 7), (None, DAY(1), 1), ("k1", None, 1)]
    want = set()
    for key in {r[0] for r in rows} - {None}:
        nights = {}
        for _, night, price in (r for r in rows if r[0] == key and r[1]):
            known = [p for p in (price, nights.get(night)) if p is not None]
            nights[night] = min(known) if known else None
        before = "none"
        for night in sorted(nights):
            if nights[night] != before:
                want.add((key, night, nights[night]))
            before = nights[night]
    kept = notes.changes(spark.createDataFrame(rows, "key string, night date, price bigint").repartition(3))
    assert {tuple(r) for r in kept.collect()} == want
    written = notes.written(kept)
    assert written.count() == 31
    back = notes.read(written)
    assert back.dtypes == [("key", "string"), ("night", "date"), ("price", "bigint")]
    assert {tuple(r) for r in back.collect()} == want and back.count() == len(want)


def test_the_form(spark):
    rows = [("a", datetime.date(2022, 1, 8), 1299), ("a", datetime.date(2022, 1, 15), 1199), ("a", datetime.date(2022, 2, 5), None), ("a", datetime.date(2022, 2, 6), 50)]
    df = spark.createDataFrame(rows, "key string, night date, price bigint")
    assert notes.written(df).first().note == "19000:1299 7:-100 21:- 1:50"
    assert not notes.read(spark.createDataFrame([("a", ""), ("b", None)], "key string, note string")).count()
