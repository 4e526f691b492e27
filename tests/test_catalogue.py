"""Catalogue operators against plain Python and literal rows."""

import datetime

from pyspark.sql import functions as F

from offerlens.functions import price as P
from offerlens.functions import text as T
from offerlens.operators import offers as O


def quotas(sizes, places):
    """Seat by seat: the next place goes to whoever has the fewest, the largest first among equals."""
    given = dict.fromkeys(sizes, 0)
    for _ in range(min(places, sum(sizes.values()))):
        name = min((n for n in sizes if given[n] < sizes[n]), key=lambda n: (given[n], -sizes[n], n))
        given[name] += 1
    return given


def test_fair_quotas(spark):
    for sizes in ({"a": 3, "b": 10, "c": 10, "d": 1}, {"a": 5}, {"a": 4, "b": 4, "c": 5}, {"a": 1, "b": 1, "c": 40}, {}):
        for percent in (0, 10, 50, 77, 100):
            groups = spark.createDataFrame(list(sizes.items()), "name string, n long")
            got = {r["name"]: r["quota"] for r in O.fair_quotas(groups, percent).collect()}
            assert got == quotas(sizes, sum(sizes.values()) * percent // 100), (sizes, percent)


def test_misspellings_split_a_text_once(spark):
    plan = spark.range(1).select(T.misspellings(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_misspellings(spark):
    df = spark.createDataFrame([(k,) for k in ["kettle", "glass lamps", "ab", "", None, "toys", "red kettle"]], "t string").select("t", T.misspellings(F.col("t")).alias("m")).select("t", "m.*")
    rows = {r["t"]: (r["missing"], r["swapped"], r["doubled"], r["joined"]) for r in df.collect()}
    assert rows["kettle"] == ("ketle", "", "ketttle", "")  # the two letters in its middle are equal
    assert rows["glass lamps"] == ("glss lamps", "galss lamps", "glaass lamps", "glasslamps")
    assert rows["toys"] == ("", "tyos", "toyys", "") and rows["red kettle"][3] == "redkettle"
    assert rows["ab"] == rows[""] == rows[None] == ("", "", "", "")


def test_currency_closeness_and_shelves(spark):
    cases = {"39.99 GBP": ("39.99", "GBP"), "GBP 39.99": ("39.99", "GBP"), "39.99": ("39.99", ""), "": ("", ""), "GBP": ("GBP", "")}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", P.amount_and_code(F.col("t")).alias("s"))
    assert {r["t"]: tuple(r["s"]) for r in df.collect()} == cases
    pairs = [("a b c d", "a b c e", True), ("a b", "a c", False), ("a", "a", True), ("", "", False), ("a b c d e", "a b c d e f g h i", False)]
    df = spark.createDataFrame([(a.split(), b.split(), c) for a, b, c in pairs], "a array<string>, b array<string>, c boolean")
    assert all(r["c"] == r["got"] for r in df.withColumn("got", T.words_close(F.col("a"), F.col("b"), 3)).collect())
    urls = {"https://s.com/Kitchen/tea-kettles/glass-kettle?x=1": "kitchen > tea kettles", "https://s.com/kettle": "", "https://s.com": "", None: ""}
    df = spark.createDataFrame([(k,) for k in urls], "u string").select("u", T.shelves(F.col("u")).alias("s"))
    assert {r["u"]: r["s"] for r in df.collect()} == urls


def test_freshness_stock_and_labels(spark):
    day = datetime.date
    rows = [("s", day(1998, 11, 30), 5), ("s", day(1998, 8, 1), 0), ("s", day(1999, 5, 1), 2), ("t", None, None)]
    got = {r["shop"]: r for r in O.freshness(spark.createDataFrame(rows, "shop string, night date, quantity long"), "shop", "1998-12-01").collect()}
    assert (got["s"]["median_age_days"], got["s"]["older_than_90"], got["s"]["quantity_zero"], got["t"]["dated"], got["t"]["median_age_days"]) == (1.0, 1, 1, 0, None)
    feed = spark.createDataFrame([(1, "in_stock"), (2, "in_stock"), (3, "sold_out")], "k long, stock string")
    seen = spark.createDataFrame([(1, day(1998, 11, 28), False), (2, day(1998, 11, 27), False)], "k long, seen date, in_stock boolean")
    assert {r["k"]: r["stock"] for r in O.stock_of_catalogue(feed, seen, ["k"], "1998-12-01", 3).collect()} == {1: "sold_out", 2: "in_stock", 3: "sold_out"}
    priced = spark.createDataFrame([("p", "a", 1), ("p", "b", 1), ("p", "c", 3), ("p", "d", None), ("q", "e", 1)], "product string, offer_id string, price long")
    labels = {r["offer_id"]: r["label"] for r in O.role_labels(priced, "product").collect()}
    assert labels == {"a": "Lowest price of these four", "b": "Lowest price of these four", "c": "Highest price of these four", "d": "Price not comparable with the others", "e": "Only option with a comparable price"}
