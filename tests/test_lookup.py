"""Fuzzy names, mended words and hierarchies against plain versions, and on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import hierarchy, names, spelling


def edits(a, b, swaps=False):
    """Levenshtein's distance; with swaps of neighbours that aren't edited again."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def overlap(a, b):
    total = 0
    for x in a:
        best = max([1 - edits(x, y) / max(len(x), len(y)) for y in b if edits(x, y) <= 2], default=0)
        total += best if best >= 0.72 else 0
    return total / max(len(a), len(b))


def skeleton(word):
    out = ""
    for c in word:
        if c in "bcdfghjklmnpqrstvwxyz" and not out.endswith(c):
            out += c
    return out


def brute_nearest(asked, entries, k):
    out = []
    for qid, q in asked:
        found = []
        for eid, name, term, kind in entries:
            a, b, t = (x.replace(" ", "") for x in (q, name, term))
            d = edits(a, b)
            if d > (4 if len(a) >= 10 and len(b) >= 10 else 3):
                continue
            s = 0.75 * (1 - d / max(len(a), len(b))) + 0.25 * overlap(q.split(), name.split())
            if a == b and q != name:
                s = min(1, s + 0.03)
            if kind in ("us_uk_spelling", "spelling_family"):
                s = min(1, s + 0.04)
            if skeleton(a) and skeleton(a) == skeleton(b):
                s = min(1, s + 0.06)
            elif skeleton(a) and skeleton(a) == skeleton(t):
                s = min(1, s + 0.05)
            if round(s, 6) >= 0.72:
                found.append((-round(s, 6), kind != "exact_canonical", eid))
        out += [(qid, p, e, -s) for p, (s, _, e) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def slip(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcde ") + word[i:], word[: i - 1] + word[i : i + 1] + word[i - 1 : i] + word[i + 1 :] if i else word]).strip()


@pytest.fixture(scope="module")
def lookups():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeorst") for _ in range(rng.randint(1, 7)))
    known = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(220)})
    entries = [(i, n, rng.choice(known), rng.choice(["exact_canonical", "missing_letter", "spelling_family", None])) for i, n in enumerate(known)]
    asked = [(i, " ".join(slip(rng, rng.choice(known)).split())) for i in range(150)]
    asked = [(i, q) for i, q in asked if q] + [(900, "zzzzzzzzzz"), (901, known[0]), (902, "a"), (903, "ab")]
    return asked, entries


def test_nearest_names_as_by_brute_force(spark, lookups):
    asked, entries = lookups
    got = names.nearest_names(spark.createDataFrame([*asked, (990, ""), (991, None)], "query_id long, query string"), spark.createDataFrame([*entries, (-1, "", "x", None), (-2, None, None, None)], "entry_id long, name string, term string, kind string"), 4)
    assert sorted((r.query_id, r.place, r.entry_id, r.score) for r in got.collect()) == [(q, p, e, pytest.approx(s, abs=2e-6)) for q, p, e, s in brute_nearest(asked, entries, 4)]


def test_keys_of_a_name_are_bounded(spark):
    """Candidates don't grow with the product of both sides: each string has so many keys at most, whatever the others are."""
    many = spark.range(3_000).selectExpr("substr(sha2(cast(id AS string), 256), 1, 14) AS a")
    met = names.near_strings(many, many.withColumnRenamed("a", "b"))
    assert met.count() == 3_000 and met.where("a = b AND distance = 0").count() == 3_000


@pytest.mark.parametrize(
    "query,want",
    [
        ("power bank", ("match", 1, 1.0, "exact_normalized_variant_match", "high")),
        ("powerbank", ("match", 1, 0.84, "fuzzy_match", "medium")),
        ("head phones", ("match", 3, None, "fuzzy_match", None)),
        ("", ("no_match", None, 0.0, "empty_query", "none")),
        ("unrelated words", ("no_match", None, 0.0, "no_candidate_found", "none")),
        ("shared", ("no_match", None, 0.0, "ambiguous_exact_collision", "none")),
        ("cable reela", ("match", 6, None, "same_canonical_cluster", None)),
    ],
)
def test_lookups(spark, query, want):
    entries = [(1, "power bank", "power bank", "exact_canonical"), (3, "headphones", "headphones", "exact_canonical"), (4, "shared", "first", "x"), (5, "shared", "second", "x"), (6, "cable reel", "cable reel", "exact_canonical"), (7, "cable reels", "cable reel", "plural")]
    got = names.looked_up(spark.createDataFrame([(1, query)], "query_id long, query string"), spark.createDataFrame(entries, "entry_id long, name string, term string, kind string")).first()
    status, entry, score, reason, sure = want
    assert (got.status, got.entry_id, got.reason) == (status, entry, reason)
    assert score is None or got.score == pytest.approx(score, abs=1e-4)
    assert sure is None or got.confidence == sure


def test_word_overlap(spark):
    rng = random.Random(1)
    rows = [(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))), " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.token_overlap(F.split("a", " "), F.split("b", " ")).alias("o")).collect()
    for r in got:
        assert r.o == pytest.approx(overlap(r.a.split(), r.b.split()))
    assert spark.sql("SELECT array('a') AS a, cast(array() AS array<string>) AS b").select(T.token_overlap(F.col("a"), F.col("b"))).first()[0] == 0


# Words.


def test_swap_distance(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"ca", "abc"})
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", spelling.swap_distance(F.col("a"), F.col("b")).alias("d"))
    for r in df.collect():
        want = edits(r.a, r.b, swaps=True)
        assert r.d == (want if want <= 2 else None), r


def test_swaps_across_a_letter(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"ca", "abc", "andretion", "arnetion", "adnretion"})
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", spelling.swap_distance(F.col("a"), F.col("b"), across=True).alias("d"))
    want = {(a, b): n if n <= 2 else None for a, b, n in duckdb.execute("SELECT a, b, damerau_levenshtein(a, b) FROM (SELECT unnest(?) AS a), (SELECT unnest(?) AS b)", [words, words]).fetchall()}
    got = {(r.a, r.b): r.d for r in df.collect()}
    assert got == want and got["ca", "abc"] == 2


def test_a_tie_across_a_letter_mends_nothing(spark):
    """One candidate is two plain edits away, the other a swap across a letter that goes: neither is sure."""
    w, x = (spark.createDataFrame([(v,) for v in s], "word string") for s in (["mandretion"], ["manhetion", "marnetion"]))
    assert spelling.mended(w, x).first().best == "manhetion" and spelling.mended(w, x, across=True).first().best == "mandretion"


def brute_mended(word, lexicon):
    if word in lexicon or len(word) < 3 or not word.isalpha():
        return word, 1.0
    if len(word) < 5:
        return word, 0.0
    found = [(edits(word, c, swaps=True), c) for c in lexicon if c[0] == word[0] and c.endswith("s") == word.endswith("s")]
    found = sorted(f for f in found if f[0] <= 2)
    if not found or len(found) > 1 and found[1][0] == found[0][0]:
        return word, 0.0
    near = 1 - found[0][0] / max(len(word), len(found[0][1]))
    return (found[0][1], round(near, 2)) if near >= 0.72 else (word, 0.0)


def brute_parted(word, lexicon):
    if word not in lexicon and len(word) >= 8:
        for i in range(3, len(word) - 2):
            (a, x), (b, y) = brute_mended(word[:i], lexicon), brute_mended(word[i:], lexicon)
            if a in lexicon and b in lexicon and (word[:i] in lexicon or word[i:] in lexicon) and round((x + y) / 2, 6) >= 0.8:
                return [a, b]
    return [word]


def test_mending_and_parting_as_by_brute_force(spark):
    rng = random.Random(3)
    lexicon = {"".join(rng.choice("abcdes") for _ in range(rng.randint(3, 9))) for _ in range(120)}
    some = sorted(lexicon)
    words = {slip(rng, rng.choice(some)).replace(" ", "") for _ in range(250)} | {rng.choice(some) + slip(rng, rng.choice(some)).replace(" ", "") for _ in range(150)} | {"ab", "a1b2c3", "ééé", some[0]}
    words.discard("")
    w, x = (spark.createDataFrame([(v,) for v in sorted(s)], "word string") for s in (words, lexicon))
    assert {r.word: (r.best, r.nearness) for r in spelling.mended(w, x).collect()} == {v: brute_mended(v, lexicon) for v in words}
    assert {r.word: r.parts for r in spelling.parted(w, x).collect()} == {v: brute_parted(v, lexicon) for v in words}


def test_normalised_rows(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("power", "bank", "wireless", "charger", "phone")], "word string")
    rows = [(1, "Powerbank!"), (2, "wireles  chargerr"), (3, "chaaaarger phone"), (4, None), (5, "  "), (6, "mobile bank"), (7, "XYZ 12")]
    got = {r.row_id: r.text for r in spelling.normalised(spark.createDataFrame(rows, "row_id long, text string"), lexicon, {"mobile": "phone"}).collect()}
    assert got == {1: "power bank", 2: "wireless charger", 3: "charger phone", 4: "", 5: "", 6: "phone bank", 7: "xyz 12"}


# Hierarchies.


def test_closure_as_by_a_walk(spark):
    rng = random.Random(4)
    edges = [(f"k{i}", f"k{rng.randint(0, i)}") for i in range(1, 60) for _ in range(rng.randint(0, 2))] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("x", "x"), ("w", "nowhere"), (None, "a"), ("a", None), ("x", "y")]
    up = {}
    for a, b in edges:
        if a and b and a != b:
            up.setdefault(a, set()).add(b)
    want = set()
    for start in up:
        seen, now, steps = {}, {start}, 0
        while now:
            steps += 1
            now = {b for a in now for b in up.get(a, ())} - set(seen) - {start}
            seen |= {b: steps for b in now}
        want |= {(start, b, s) for b, s in seen.items()}
    paths = hierarchy.closure(spark.createDataFrame(edges, "kind string, broader string"))
    assert {tuple(r) for r in paths.collect()} == want
    members = [(1, "c0"), (1, "c5"), (2, "lonely"), (2, "__mark"), (3, "__mark"), (4, "c39"), (4, "w"), (5, None)]
    got = {r.member: (r.kind, r.depth) for r in hierarchy.narrowest(spark.createDataFrame(members, "member long, kind string"), paths).collect()}
    assert got == {1: ("c0", 40), 2: ("lonely", 0), 3: ("", 0), 4: ("w", 1), 5: ("", 0)}
    met = hierarchy.related(spark.createDataFrame([("c3",), ("x",), ("lonely",)], "kind string"), spark.createDataFrame([("c1",), ("c3",), ("c9",), ("y",), ("lonely",)], "other string"), paths)
    assert sorted((r.kind, r.other, r.relation) for r in met.collect()) == [("c3", "c1", "narrower"), ("c3", "c3", "same"), ("c3", "c9", "broader"), ("lonely", "lonely", "same"), ("x", "y", "broader")]


def test_words_that_nothing_explains(spark):
    rng = random.Random(12)
    known = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))), rng.randint(1, 5)) for _ in range(150)]
    known = list({w: (w, n) for w, n in known}.values())
    words = sorted({slip(rng, rng.choice(known)[0]).replace(" ", "") for _ in range(80)} - {""})
    k = spark.createDataFrame([*known, (None, 3)], "word string, n long")
    asked = spark.createDataFrame([(1, words[:40]), (2, words[30:]), (3, None), (4, [""])], "query_id long, words array<string>")
    left = names.unexplained(asked, k)
    names_ = {w for w, _ in known}
    assert {(r.query_id, r.word) for r in left.collect()} == {(q, w) for q, ws in ((1, words[:40]), (2, words[30:])) for w in ws if w not in names_}
    want = []
    for w in {w for w in words if w not in names_}:
        near = [(edits(w, v), -n, v) for v, n in known]
        fits = sorted(x for x in near if x[0] <= min(4 if len(w) >= 10 and len(x[2]) >= 10 else 3, int(max(len(w), len(x[2])) * (1 - (0.6 - 0.38) / 0.75) + 1e-9)))
        want += [(w, i, v, d) for i, (d, _, v) in enumerate(fits[:3], 1)]
    assert sorted(map(tuple, names.did_you_mean(left, k).collect())) == sorted(want)
