"""Kind choices against a plain version, and on literal titles."""

import collections
import random

from offerlens.operators.choices import kind_choices

SCHEMA = "kind string, shop string, word string, before string"


def plain(rows, min_products, min_group, min_word, generic, kept):
    rows = [r for r in rows if r[0] is not None]
    size = collections.Counter(r[0] for r in rows)
    kinds = {k for k, n in size.items() if n >= min_products}
    titles = collections.defaultdict(list)
    for kind, shop, word, before in rows:
        if kind in kinds and word is not None:
            titles[kind, word].append((before, shop))
    count = {key: len(v) for key, v in titles.items()}
    before_kinds = collections.Counter(w for (_, w), n in count.items() if n >= min_word)
    users = collections.defaultdict(set)
    for (_, w), v in titles.items():
        users[w] |= {s for _, s in v if s is not None}
    pairs = collections.Counter((k, b, w) for (k, w), v in titles.items() for b, _ in v if b is not None)
    nouns = collections.Counter((b, w) for (k, b, w), n in pairs.items() if n >= min_word)
    out = []
    for kind in kinds:
        found = []
        for (k, word), v in titles.items():
            if k != kind or before_kinds[word] >= generic:
                continue
            whole = {b for b, _ in v if b is not None and (b.isdigit() or nouns[b, word] >= 2) and count.get((kind, b), 0) < min_word}
            half = sum(b in whole for b, _ in v) * 100 >= len(v) * 75
            groups = {f"{b} {word}": [s for x, s in v if x == b] for b in whole} if half else {word: [s for _, s in v]}
            for name, shops in groups.items():
                several = len({s for s in shops if s is not None}) > 1 or len(users[word]) > 1
                if len(shops) >= min_group and several and len(shops) * 100 < size[kind] * 90:
                    found.append((-len(shops), name))
        if len(found) >= 2:
            out += [(kind, name, -n, size[kind], i) for i, (n, name) in enumerate(sorted(found)[:kept], 1)]
    return sorted(out)


def test_choices_as_by_a_plain_walk(spark):
    rng = random.Random(8)
    pick = lambda names, p=1.0: rng.choice(names) if rng.random() < p else None
    rows = []
    for k in range(14):
        own = [f"w{rng.randint(0, 30)}" for _ in range(6)] + ["new", "fit"]
        for _ in range(rng.randint(20, 160)):
            word = pick(own, 0.9)
            rows.append((f"k{k}", pick([f"s{k % 3}", "s1", "s2"], 0.95), word, pick({"fit": ["slim", "loose", "3"]}.get(word, [*own, "3", "x"]), 0.8)))
    rows += [(None, "s", "w", None), ("k1", None, None, None)] + [("one", "s9", "only", None)] * 60 + [("one", "s9", "lonely", None)] * 30
    for args in ((50, 8, 3, 8, 12), (30, 4, 2, 5, 3)):
        got = kind_choices(spark.createDataFrame(rows, SCHEMA).repartition(4), **dict(zip(("min_products", "min_group", "min_word", "generic_kinds", "kept"), args, strict=True)))
        want = plain(rows, *args)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_halves_of_phrases(spark):
    rows = [("suit", s, "fit", "slim") for s in "ab" * 20] + [("jeans", s, "fit", "slim") for s in "ab" * 20] + [("suit", s, "piece", "3") for s in "ab" * 20] + [("suit", s, "wool", None) for s in "ab" * 15] + [("jeans", "a", "bootcut", None)] * 25
    got = kind_choices(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == [("suit", "3 piece", 40, 110, 1), ("suit", "slim fit", 40, 110, 2), ("suit", "wool", 30, 110, 3)]
    assert not kind_choices(spark.createDataFrame([], SCHEMA)).count()


def test_sentences_are_read_once(spark):
    """All that follows from the sums reads those: the plan has no scan of the documents (before, five)."""
    from __spark_entry__ import queries

    from tests.conftest import DATA

    assert "parquet" not in queries()["agg17_kind_choices"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
