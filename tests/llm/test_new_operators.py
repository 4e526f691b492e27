"""Exact inner products, repair of conversations and collocations against brute-force versions, and on the cases that their docstrings define."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("offerlens.llm")

from offerlens.llm import collocations, conversations, mtree, substring_dedup  # noqa: E402
from offerlens.llm.queries import QUERIES  # noqa: E402
from tests.conftest import DATA  # noqa: E402

EXTRA = ("n", "key", "rank", "score", "place", "block", "kind", "symbols", "live", "chunk", "final", "words", "asks", "__at", "__text")


def frame(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r) for r in rows], schema).selectExpr(*names, *[f"'x' AS `{c}`" for c in EXTRA])


# Inner products.


def brute_products(rows, every, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
    out = []
    for q, own in usable.items():
        if q % every == 0:
            asks = min(own)
            scored = sorted((-sum(a * b for a, b in zip(asks, v, strict=False)), i) for i, vs in usable.items() if i != q for v in vs)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_products_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 12))
    x[100:400] = x[100]
    x[400:700] = np.round(x[400:700], 1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, []), (None, [1.0] * 12), (5100, [float("nan")] * 12), (5150, [1.0, None]), (5200, [float("inf")]), (5250, [0.5, -0.25]), (5300, [0.0] * 12), (0, [2.0] * 12), (7, [float(c) for c in x[7]])]
    got = mtree.best_products(frame(spark, rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, k=5, page=8, query_block=10)
    assert sorted(map(tuple, got.collect())) == brute_products(rows, 50, 5)
    few = mtree.best_products(frame(spark, [(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 256 * 512)]
    assert not mtree.best_products(frame(spark, [], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count()


@pytest.mark.parametrize("kind", ["even", "clusters", "copies", "large"])
def test_the_tree_gives_the_best_and_its_bounds_save_work(kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4_000, 32))
    if kind == "clusters":
        x = 4 * x[rng.integers(0, 40, 4_000)] + 0.1 * x
    if kind == "copies":
        x[:2_500] = x[0]
    x = np.floor(x * (1e8 if kind == "large" else 256))
    ids = rng.permutation(4_000)
    tree = mtree.Tree(ids, x, page=16)
    for at in range(0, 4_000, 200):
        scores = [sum(int(a) * int(b) for a, b in zip(v, x[at], strict=True)) for v in x] if kind == "large" else (x @ x[at]).astype(np.int64).tolist()
        want = sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != ids[at])[:5]
        found = tree.search(int(ids[at]), x[at], 5)
        assert list(zip((-found[1]).tolist(), found[0].tolist(), strict=True)) == want
    if kind == "clusters":
        assert tree.computed < 0.25 * 20 * 4_000


# Conversations.


def brute_repair(rows):
    """conv_id to its answer; rows: conv_id, turn, role, text."""
    spaces = " \t\n\x0b\x0c\r"
    per = collections.defaultdict(list)
    for c, t, role, text in rows:
        own = per[c]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    out = {}
    for c, own in per.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(spaces)
            faults.append("blank" if not bare.strip(spaces) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        states = {"": (0, "", ())}

        def inserted(states):
            for _ in range(4):
                for s, (cost, audit, lines) in list(states.items()):
                    t = "a" if s == "u" else "u"
                    new = (cost + 2, audit + "I", (*lines, "user:" if t == "u" else "assistant:"))
                    if t not in states or new[:2] < states[t][:2]:
                        states[t] = new
            return states

        for (_, role, text), fault in zip(own, faults, strict=True):
            new = {}
            for s, (cost, audit, lines) in inserted(states).items():
                ways = [(s, 3, "D", ())]
                if fault in ("", "truncated"):
                    extra = fault == "truncated"
                    t = "a" if s == "u" else "u"
                    ways.append((t, 2 + extra, "R", (("user:" if t == "u" else "assistant:") + text,)))
                    if role[:1] in after[s]:
                        ways.append((role[:1], extra, "K", (f"{role}:{text}",)))
                for t, more, letter, line in ways:
                    way = (cost + more, audit + letter, (*lines, *line))
                    if t not in new or way[:2] < new[t][:2]:
                        new[t] = way
            states = new
        cost, audit, lines = min(v for s, v in inserted(states).items() if s in ("", "a"))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[c] = (c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same_repairs(got, rows):
    got = {r["conv_id"]: tuple(r) for r in got.collect()}
    want = brute_repair(rows)
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], c


def random_rows(seed, n, longest):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "author"], ["Fine.", "Cut", "", " \t", None, "Yes!  ", "Why?\n", "a.b", "é.", "One. Two", " "]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            out.append((c, t + (rng.random() < 0.1), role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 6)}."))
    return out


def test_repairs_as_by_brute_force(spark):
    rows = random_rows(1, 250, 9)
    rows += [(None, None, None, None), (None, 1, "user", "A."), (None, 2, "assistant", "B."), (9000, None, "user", "x"), (9000, -5, "user", "y."), (9001, None, "system", "S."), (9001, None, "system", "S.")]
    rows += [(9002, t, r, "Same.") for t in range(40) for r in ("user", "assistant")] + [(9003, 7, "user", "Copy.")] * 50
    dropped = next(c for c in range(20_000, 30_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    got = conversations.repaired(frame(spark, rows, "conv_id long, turn long, role string, text string").repartition(5))
    same_repairs(got, rows)
    gone = got.where(f"conv_id = {dropped}").first()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_passes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"Line {rng.randint(0, 500)}" + rng.choice([".", "", "!"])) for t in range(1_500)] + random_rows(3, 20, 5)
    rows = [(c + 10 if i >= 1_500 else c, *r) for i, (c, *r) in enumerate(rows)]
    same_repairs(conversations.repaired(frame(spark, rows, "conv_id long, turn long, role string, text string").repartition(7), rules=40), rows)


def test_rules_change_nothing_but_the_length():
    rng = random.Random(2)
    symbols = [conversations.symbol(c, f) for c in "suao" for f in conversations.FAULTS]
    sequences = ["".join(rng.choice(symbols[:9] if rng.random() < 0.8 else symbols) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    bare, ruled = conversations.Grammar(), conversations.Grammar()
    for _ in range(25):
        pairs = collections.Counter(p for s in sequences for p in map("".join, itertools.pairwise(ruled.compressed(s))))
        left, right = max(pairs, key=lambda p: (pairs[p], p))
        ruled.add(ord(left) - conversations.FIRST, ord(right) - conversations.FIRST)
    assert sum(map(len, map(ruled.compressed, sequences))) < 0.8 * sum(map(len, sequences))
    for s in sequences:
        (a, x), (b, y) = bare.passed(conversations.START, s), ruled.passed(conversations.START, s)
        assert [(c, a + e) for c, e in x if c < conversations.INF] == [(c, b + e) for c, e in y if c < conversations.INF]


def test_no_conversations(spark):
    assert not conversations.repaired(frame(spark, [], "conv_id long, turn long, role string, text string")).count()


def test_the_query_of_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same_repairs(QUERIES["op12_conversation_repair"](spark, DATA), rows)


# Collocations.


def brute_phrases(rows, least, inside, first):
    """Counts by a plain walk over all pieces."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    out = []
    for lang in n:
        own = []
        for (x, g), a in candidates.items():
            if x == lang:
                longer = [b for (y, h), b in candidates.items() if y == lang and len(h) > len(g) and g in (h[:2], h[1:])]
                if any(100 * b >= inside * a for b in longer):
                    continue
                s, k = min((1_000_000 * a * a // (f[x, g[:k]] * f[x, g[k:]]), k) for k in range(1, len(g)))
                own.append((-s, -a, " ".join(g).encode(), f[x, g[:k]], f[x, g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:first], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "A-B", " x", "the", "THE", "\x1f"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(150))
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.choice((5, 20, 67))]) for _ in range(rng.randint(0, 120))]
        text = "".join(w + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "; \n", "!?"]) for w in words)
        out.append((text + (passage if rng.random() < 0.3 else ""), rng.choice(["en", "de", None, "und", "x y"])))
    return [*out, out[0], out[0], (None, "en"), ("", None), ("one", "fr"), ("one two", "fr"), (" .,;\n", "de"), ("the " * 30_000, "hot"), ("no trigger. " * 2_000, "hot")]


@pytest.mark.parametrize("period,longest", [(32, 4_096), (3, 50), (1, 10)])
def test_collocations_as_by_brute_force(spark, period, longest):
    rows = texts(period, 150)
    got = collocations.collocations(frame(spark, rows, "text string, lang string").repartition(4), least=10, inside=50, first=60, period=period, longest=longest)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 10, 50, 60)


def test_chunks_overlap_and_hold_every_word_once():
    rows = [t.encode() for t, _ in texts(9, 40) if t]
    for period, longest in ((8, 64), (1, 4), (10**9, 7)):
        found = collections.defaultdict(list)
        for t, final, chunk in collocations.chunks_of(rows, period, longest):
            found[t].append((final, re.split(b"[ \n]", chunk)))
            assert len(found[t][-1][1]) <= longest + collocations.OVERLAP or longest > 10
        for t, text in enumerate(rows):
            want = [w for w in re.split(rb"[ \t.,;:!?\n\x0b\x0c\r]+", text.lower()) if w]
            parts = found.get(t, [])
            assert [w for f, c in parts for w in (c if f else c[: -collocations.OVERLAP])] == want
            assert [f for f, _ in parts] == [False] * (len(parts) - 1) + [True] * bool(parts)


def test_equal_passages_share_chunks(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(3_000))
    rows = [(f"{rng.random()} {i} start " + passage + f" end {i}", "en") for i in range(30)]
    chunks = collocations.dictionary(frame(spark, rows, "text string, lang string"))
    held = chunks.selectExpr("sum(length(chunk)) AS own", "sum(length(chunk) * n) AS times").first()
    assert held.own < 0.1 * held.times


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 7)
    rows = texts(4, 60)
    got = collocations.collocations(frame(spark, rows, "text string, lang string"), least=10, inside=50, first=60)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 10, 50, 60)


def test_no_texts(spark):
    assert not collocations.collocations(frame(spark, [], "text string, lang string")).count()


def test_passages_go_beside_columns_of_any_name(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"first\n{line}\nlast"), (2, f"other\n{line}\nend"), (3, None), (4, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "'x' AS spans", "text", "'y' AS __id", "'z' AS id", "'w' AS was", "'r' AS row", "'d' AS `a.b`")
    got = substring_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r for r in got.collect()}
    assert [kept[i].text for i in (1, 3, 4)] == [rows[0][1], None, "alone"] and line not in kept[2].text and kept[2].spans == "x" and kept[2]["a.b"] == "d"
