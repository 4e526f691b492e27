"""The pipeline's stages on small tables against naive versions of each, one after another."""

import collections
import random
import re

import pytest

pytest.importorskip("offerlens.llm")

import corpus_pipeline  # noqa: E402
from offerlens.llm import packing, quality  # noqa: E402
from offerlens.llm.queries import vocabulary  # noqa: E402
from tests.llm.test_llm_operators import brute_components, brute_lines, checked_packing  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    good = [f"word{i}" for i in range(800)]
    texts, labels = [], []
    for i in range(90):
        junk = i % 3 == 0
        lines = ["$$$ " + " ".join("XX%d#!" % rng.randrange(30) for _ in range(20)) if junk else " ".join(rng.choices(good, k=rng.randint(8, 25))) for _ in range(5)]
        texts.append("\n".join(lines))
        labels.append((i, int(not junk), 0))
    shared = " ".join(rng.choices(good, k=20))
    for i in (1, 4, 7):
        texts[i] += "\n" + shared
    texts[10] = texts[8].replace("\n", " ", 1)  # one line is new, the rest repeat
    whole = " ".join(rng.choices(good, k=200))
    texts[13], texts[14] = whole + " end", whole + " stop"
    item = " ".join(rng.choices(good, k=18))
    texts[16] += " " + item
    texts += [None, "", " \n ", texts[2], " ".join(rng.choices(good, k=5_000))]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[5], "en", "s", len(texts[5])), (17, texts[17], "en", "s", len(texts[17]))]
    return docs, labels, [(1, item), (2, None), (None, "x y z a b c d e")]


def naive_lines(docs):
    gone = brute_lines([t for _, t in docs])
    out = []
    for i, (k, t) in enumerate(docs):
        left = [x for j, x in enumerate((t or "").split("\n")) if (i, j) not in gone]
        if not any(g[0] == i for g in gone):
            out.append((k, t))
        elif "\n".join(left).strip():
            out.append((k, "\n".join(left)))
    return out


def test_stages_match_naive_versions(spark, rows, tmp_path):
    folder = written(spark, tmp_path, *rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "line dedup", "near dedup", "decontamination", "best-fit packing"]

    def through(name, df):
        out = steps[name](spark, df, folder)
        assert out.columns == df.columns or name == "best-fit packing"
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        return spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")

    kept = through("quality classifier", docs)
    scores = quality.scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1")
    assert collections.Counter(r[0] for r in kept.select("doc_id").collect()) == collections.Counter(r[0] for r in scores.select("doc_id").collect())
    assert {1, 2, 4, 7, 13, 14, 16} <= {r[0] for r in kept.select("doc_id").collect()} and not {0, 3, 6, 91, 92} & {r[0] for r in kept.select("doc_id").collect()}

    plain = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])  # the naive versions know no repeated ids
    lined = through("line dedup", plain)
    before = sorted((r["doc_id"], r["text"]) for r in plain.collect())
    naive = naive_lines(before)
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == naive and len(naive) < len(before)
    assert all(r["n_chars"] == len(r["text"] or "") for r in lined.collect())

    near = through("near dedup", lined)
    assert [naive[i][0] for i, _, _, first in brute_components([t for _, t in naive], 5, 80) if first] == sorted(r["doc_id"] for r in near.collect())

    clean = through("decontamination", near)
    item = rows[2][0][1].split()
    parts = [" " + " ".join(item[j : j + 13]) + " " for j in range(6)]
    held = lambda t: any(p in " " + " ".join(re.findall(r"\w+", t.lower())) + " " for p in parts)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in near.collect() if not held(r["text"])) and 16 not in [r["doc_id"] for r in clean.collect()]

    packed = through("best-fit packing", clean).collect()
    encode = packing.tokenizer(vocabulary())
    lengths = collections.Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {r["doc_id"]: len(encode([r["text"]])[0]) + 1 for r in clean.collect()}
    checked_packing(packed, 2048)


def test_run_with_nulls_repeats_and_clashing_names(spark, rows, tmp_path):
    folder = written(spark, tmp_path, *rows)
    found = corpus_pipeline.run(spark, folder).collect()
    ids = collections.Counter(r["doc_id"] for r in found if r["piece"] == 0)
    assert ids[17] == 1 and ids[None] <= 1 and ids[2] == 1 and not ids[94 - 1]
    extra = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"'x' AS `{c}`" for c in ("key", "rank", "node", "score", "length", "line", "spans", "__id", "quality", "prefix")])
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, extra, folder).columns == extra.columns, name


def test_run_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [], [])).collect() == []
