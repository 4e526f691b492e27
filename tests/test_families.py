"""Titles parted, variant keys and families against literal rows and plain walks."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from offerlens.functions import variants as V
from offerlens.operators.families import cheaper_elsewhere, doubtful_sets, set_members

TITLES = {
    "Runner Size 9 White": (["runner"], ["size", "~9"], ["white"]),
    "iPhone 15 128GB - Black": (["iphone"], ["128gb"], ["15", "black"]),
    "Fluted Kettle 1.7L, Kettle": (["fluted", "kettle"], ["17l"], []),
    "UK 10 EU 42 Boot 7": (["boot"], ["eu", "uk", "~10", "~42"], ["7"]),
    "Shirt XL Small m 2XL 9x": (["shirt"], ["2xl", "m", "small", "xl"], ["9x"]),
    "size": ([], ["size"], []),
    "--- α": ([], [], []),
    "": ([], [], []),
    None: ([], [], []),
}


def test_title_parts(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string").select("t", V.title_parts(F.col("t")).alias("p"))
    assert {r["t"]: (r["p"]["own"], r["p"]["sizes"], r["p"]["others"]) for r in df.collect()} == TITLES


def test_keys(spark):
    rows = [
        ("Satin Sleep Mask - Snake Print - Red", "satin sleep mask snake print", "satin sleep mask", "red"),
        ("Mug | Blue Cup", "mug cup", "mug cup", "blue"),  # the head has one own word only
        ("Red Wine Glass 500ml", "wine glass", "wine glass", "red"),
        ("Wine-glass, 2 Black", "wine glass", "wine glass", "2 black"),
        ("Mug", None, None, None),
        (None, None, None, None),
    ]
    key = [f(F.lit("s"), F.lit(" Acme "), F.col("t")).alias(n) for n, f in (("f", V.family_key), ("h", V.head_key), ("a", V.sizes_apart_key))]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select("t", *key).collect()
    start = lambda x: None if x is None else f"s\x1facme\x1f{x}"
    assert {tuple(r) for r in got} == {(t, start(f), start(h), None if f is None else f"{start(f)}\x1f{o}") for t, f, h, o in rows}
    none = spark.range(1).select(V.family_key(F.lit(None).cast("string"), F.lit("b"), F.lit("two words")).alias("a"), V.family_key(F.lit(""), F.lit("b"), F.lit("two words")).alias("b"), V.family_key(F.lit("s"), F.lit(None).cast("string"), F.lit("two words")).alias("c"))
    assert tuple(none.first()) == (None, None, "s\x1f\x1ftwo words")


def test_differences(spark):
    pairs = {("Red Wine Glass", "White Wine Glass"): "doubtful", ("Shirt Tee S", "Shirt Tee 2XL"): "certain", ("Disk Drive 500GB", "Disk Drive 1TB"): "certain", ("Phone Case 15", "Phone Case 16"): "doubtful", ("A B", "a b"): None}
    df = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", V.variant_difference(V.title_parts(F.col("a")), V.title_parts(F.col("b"))).alias("d"))
    assert {(r["a"], r["b"]): r["d"] for r in df.collect()} == pairs


def parts(title):
    words = re.findall("[0-9a-z]+", title.lower())
    other = {w for i, w in enumerate(words) if w in V.COLOURS or (re.fullmatch("[0-9]+", w) and words[max(i - 1, 0)] not in V.SIZE_WORDS)}
    size = {w for i, w in enumerate(words) if w in V.LETTER_SIZES + V.SIZE_WORDS or (re.fullmatch("[0-9]+", w) and i and words[i - 1] in V.SIZE_WORDS)}
    return [w for w in words if w not in other and w not in size], tuple(sorted(other))


def plain_sets(rows, most):
    """Listings of every set by a plain walk that compares all pairs."""
    heads = collections.defaultdict(lambda: collections.defaultdict(list))
    for shop, brand, title, price, page, pid in rows:
        if not shop or price is None or title is None:
            continue
        own = lambda text: " ".join(dict.fromkeys(parts(text)[0]))
        short = own(re.split(r"\s-\s|,\s", title)[0])
        key = short if len(short.split()) > 1 else own(title)
        if len(key.split()) > 1:
            heads[shop.strip().lower(), (brand or "").strip().lower(), key][page or f"product:{pid}"].append((price, title, f"{shop.strip().lower()}\x1f{pid}"))
    found = []
    for units in heads.values():
        merged = collections.defaultdict(list)
        for offers in units.values():
            best = min(offers)
            merged[tuple(dict.fromkeys(parts(best[1])[0])), parts(best[1])[1]].append((best, offers))
        listed = sorted((min(b for b, _ in group), sorted(o[2] for _, os in group for o in os)) for group in merged.values())
        if 2 <= len(listed) <= most and any(parts(a[0][1])[1] != parts(b[0][1])[1] for a, b in itertools.combinations(listed, 2)):
            found.append(tuple((best[1], best[0], tuple(refs)) for best, refs in listed))
    return collections.Counter(found)


SCHEMA = "shop string, brand string, title string, price int, page string, product_id string"


@pytest.mark.parametrize("most", [40, 4])
def test_doubtful_sets_as_by_all_pairs(spark, most):
    rng = random.Random(most)
    rows = []
    for i in range(700):
        title = f"{rng.choice(['Oak Table', 'Pine Chair', 'Mug', 'Lamp Shade'])}{rng.choice([' Red', ' Blue', '', ' 5', ' Size 9'])}{rng.choice([' - Snake Print', ', Large Dots', '', ' XL'])}"
        rows.append((rng.choice(["A", " a", "b", "c", "", None]), rng.choice(["x", "X ", None]), rng.choice([title] * 9 + [None]), rng.choice([None, *range(20)]), rng.choice([f"p{i % 90}", None]), str(i)))
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA)
    members = collections.defaultdict(list)
    for r in set_members(df, most).collect():
        members[r["set_id"], r["listing"]].append(r["ref"])
    sets = collections.defaultdict(list)
    for r in sorted(doubtful_sets(df.repartition(5), most).collect()):
        assert len(members[r["set_id"], r["listing"]]) == r["n_products"]
        sets[r["set_id"]].append((r["title"], r["price"], tuple(sorted(members[r["set_id"], r["listing"]]))))
    got = collections.Counter(map(tuple, sets.values()))
    assert got == plain_sets(rows, most) and len(got) > 5


def test_no_products_and_one_page(spark):
    assert not doubtful_sets(spark.createDataFrame([], SCHEMA)).count()
    rows = [("a", "b", f"Oak Table {c}", 5, "one page", c) for c in ("Red", "Blue")]
    assert not doubtful_sets(spark.createDataFrame(rows, SCHEMA)).count()
    rows = [("a", "b", f"Oak Table {c}", 5, None, c) for c in ("Red", "Blue", "Blue XL")]
    assert [tuple(r)[1:] for r in sorted(doubtful_sets(spark.createDataFrame(rows, SCHEMA)).collect())] == [(1, "b", "Oak Table Blue", 5, 2), (2, "b", "Oak Table Red", 5, 1)]


def test_cheaper_elsewhere(spark):
    rows = [("p", "red", "A", 20), ("p", "green", "A", 22), ("p", "green", "A", 25), ("p", "green", "B", 18), ("p", "red", "C", 20), ("p", "red", "D", 5), ("p", "blue", "D", 9), ("p", "blue", "E", 1), ("p", "red", None, 1),
            ("q", "one", "A", 3), ("q", "one", "B", 2), ("r", "x", "A", 3), ("r", "y", "B", 2), ("t", None, "A", 4), ("t", "z", "A", 4), ("t", None, "B", 3), (None, "x", "A", 1), ("p", "red", "A", None)]
    got = {tuple(r) for r in cheaper_elsewhere(spark.createDataFrame(rows, "product string, variant string, shop string, price int")).collect()}
    # D has two variants as A has, and is cheaper: the card is D's.
    assert {r for r in got if r[0] == "p"} == {("p", "red", "A", 20, "D", 5, False), ("p", "green", "A", 22, "D", None, False), ("p", "green", "B", 18, "D", None, False), ("p", "red", "C", 20, "D", 5, False), ("p", "red", "D", 5, "D", 5, False), ("p", "blue", "D", 9, "D", 9, False), ("p", "blue", "E", 1, "D", 9, True), ("p", "red", "", 1, "D", 5, False)}
    assert {r for r in got if r[0] in "qr"} == {("q", "one", "A", 3, None, None, False), ("q", "one", "B", 2, None, None, False), ("r", "x", "A", 3, None, None, False), ("r", "y", "B", 2, None, None, False)}
    assert {r for r in got if r[0] == "t"} == {("t", None, "A", 4, "A", 4, False), ("t", "z", "A", 4, "A", 4, False), ("t", None, "B", 3, "A", 4, True)}


def test_cheaper_elsewhere_moves_the_offers_once(spark):
    """All of a product is in one task, so no join moves the offers again (before, each of three)."""
    offers = spark.range(100).selectExpr("cast(id % 5 AS string) AS product", "id % 7 AS variant", "cast(id % 3 AS string) AS shop", "id AS price")
    plan = cheaper_elsewhere(offers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
