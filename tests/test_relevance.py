"""Relevance against a plain scorer, and keys of products on literal rows."""

import random
import re

from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import relevance

FIELDS = ("title", "product_type", "category", "brand", "keywords", "description")
WEIGHTS = dict(zip(FIELDS, (100, 55, 40, 35, 20, 5), strict=True))


def plain(asked, offers, k, accessories):
    out = []
    for qid, required, words, phrase, types, accessory in asked:
        found = []
        for oid, *texts, complete in offers:
            f = {n: (t or "").lower() for n, t in zip(FIELDS, texts, strict=True)}
            hits = {w: [n for n in FIELDS if w in f[n]] for w in {*required, *words}}
            if not all(hits[w] for w in required) or types and f["product_type"] and f["product_type"] not in types:
                continue
            score = sum(WEIGHTS[n] for w in words for n in hits[w])
            in_title = sum("title" in hits[w] for w in words)
            tokens = re.split(r"[^\w]+", f["title"])
            penalty = 0 if accessory else 220 * sum(a in tokens for a in accessories)
            score += 150 * bool(phrase and phrase in f["title"]) + 80 * (in_title >= len(required)) + 20 * any({"product_type", "category"} & set(hits[w]) for w in words)
            score += 60 * (required[-1] in tokens) + 130 * bool(types and f["product_type"] in types) - penalty + 40 * (penalty == 0 and not accessory) + 25 * bool(complete)
            found.append((-sum(bool(hits[w]) for w in words), -score, -in_title, f["title"], oid))
        out += [(qid, p, o, -m, -s, -t) for p, (m, s, t, _, o) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_answers_as_by_a_plain_scorer(spark):
    rng = random.Random(3)
    names = ["usb", "hub", "cable", "a", "tv", "stand", "standard", "case", "Kettle", "blue", "x1"]
    some = lambda p: " ".join(rng.choice(names) for _ in range(rng.randint(0, 3))) if rng.random() < p else None
    offers = [(i, some(0.95), rng.choice([None, "Cable", "hub", "tv"]), some(0.5), some(0.5), some(0.3), some(0.4), rng.random() < 0.5) for i in range(150)]
    asked = [(i, (r := [rng.choice(names).lower() for _ in range(rng.randint(1, 3))]), r + [rng.choice(names).lower()], rng.choice(["", None, " ".join(r)]), rng.choice([None, [], ["cable"], ["hub", "tv"]]), rng.random() < 0.3) for i in range(40)]
    asked.append((99, ["nowhere"], ["nowhere"], "", None, False))
    a = spark.createDataFrame(asked, "query_id long, required array<string>, words array<string>, phrase string, types array<string>, accessory boolean")
    o = spark.createDataFrame(offers, "offer_id long, " + ", ".join(f"{n} string" for n in FIELDS) + ", complete boolean").withColumn("query_id", F.lit("x"))
    got = relevance.best_answers(a, o.drop("query_id"), 7, ["case", "stand"])
    want = plain(asked, offers, 7, ["case", "stand"])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    # A query meets no more offers than its rarest piece has.
    assert relevance.candidates(a, o.drop("query_id")).where("query_id = 99").count() == 0


def test_answers_are_scored_by_many_tasks(spark):
    """Few bytes of offers, every one of which answers: the scoring isn't left to the one or two tasks that so few bytes would get."""
    a = spark.createDataFrame([(1, ["hub"], ["hub"], "hub", None, False)], "query_id long, required array<string>, words array<string>, phrase string, types array<string>, accessory boolean")
    o = spark.range(2_000).select(F.col("id").alias("offer_id"), F.concat(F.lit("Hub "), "id").alias("title"), *[F.lit(None).cast("string").alias(n) for n in FIELDS[1:]], F.lit(True).alias("complete"))
    rows = relevance.scored(a, o).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 2_000 and len(rows) >= 16 and max(r["count"] for r in rows) < 200


def test_keys_of_products(spark):
    rows = [
        ("4006381333931", None, "Pen", "X1", "gtin:04006381333931", "gtin:04006381333931"),
        ("4006381333932", "036000291452", "Pen", "X1", "gtin:00036000291452", "gtin:04006381333932"),
        ("0000000000000", None, " Big  Pen ", "ab 12", "mpn:big pen|ab 12", "mpn:big pen|ab 12"),
        (None, "", "Pen", "Black", "", "mpn:pen|black"),
        (None, None, "Pen", "ABlack", "mpn:pen|ablack", "mpn:pen|ablack"),
        (None, None, "", "X1 2", "", ""),
        ("12", None, "Pen", "a 1 b 2 c", "", "mpn:pen|a 1 b 2 c"),
        ("400-638 1333931", None, None, None, "gtin:04006381333931", "gtin:04006381333931"),
        (None, None, None, None, "", ""),
    ]
    df = spark.createDataFrame(rows, "a string, b string, brand string, mpn string, same string, older string")
    codes, parts = [F.col("a"), F.col("b")], [F.col("mpn")]
    for r in df.select("*", T.same_product_key(codes, F.col("brand"), parts).alias("k"), T.identity_key(codes, F.col("brand"), parts).alias("i")).collect():
        assert (r.k, r.i) == (r.same, r.older), r
