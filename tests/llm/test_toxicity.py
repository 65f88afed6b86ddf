import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from loamwork.llm import toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("doc_id", "text", "quality", "toxic").orderBy("doc_id").collect()
    rows = [r for r in rows if r.doc_id % 2] + [r for r in rows if not r.doc_id % 2]
    half = sum(r.doc_id % 2 for r in rows)
    texts, labels = [r.text for r in rows], np.array([[int(r.quality == 0), r.toxic] for r in rows])
    seen = set(texts[:half])
    chain = toxicity.Chain(toxicity.train_chain(texts[:half], labels[:half]))
    new = [i for i in range(half, len(rows)) if texts[i] not in seen]
    p = chain.predict(pa.array([texts[i] for i in new], pa.large_string()))[:, 1]
    y = labels[new, 1]
    ranks = np.argsort(np.argsort(p))
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.97
    assert ((p >= 0.5) & (y == 1)).sum() > 0.85 * y.sum() and ((p >= 0.5) & (y == 0)).sum() < 0.02 * (y == 0).sum()


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(2)
    first = rng.integers(0, 2, 400)
    texts = [" ".join(["bad"] * f + list(rng.choice([f"w{i}" for i in range(50)], 20))) for f in first]
    models = toxicity.train_chain(texts, np.c_[first, first])
    assert [len(m.weights) - len(m.features) for m in models] == [toxicity.DENSE + 1, toxicity.DENSE + 2]
    assert models[1].weights[-2] > 0.5  # that of the first category's probability


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_odd_rows(spark, docs, tmp_path):
    rows = [(i, "you idiot loser go away " * 3 if i % 2 else "a calm and kindly text " * 3) for i in range(60)] + [(100, None), (101, ""), (None, "idiot"), (5, "twice"), (102, "idiot " * 50_000)]
    d = docs(*rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, *((i, 1 - i % 2, i % 2) for i in range(40)), (41, None, 1), (None, 1, 1), (3, 0, 1), (999, 1, 0)).write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert by[51].toxic and not by[52].toxic and by[100].p_toxic == by[101].p_toxic
    assert all(0 <= r[k] <= 1 for r in got for k in ("p_low_quality", "p_toxic", "p_severe_toxic"))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None)]])
def test_few_labels(spark, docs, tmp_path, labels):
    docs((1, "a"), (2, "b")).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, (0, 0, 0), *labels).filter("doc_id > 0").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.p_toxic for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    assert got == ({0.0} if len(labels) == 2 else {0.5})


def test_empty(spark, docs, tmp_path):
    docs((1, "a")).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, (1, 1, 1)).write.parquet(str(tmp_path / "labels.parquet"))
    assert toxicity.op8_toxicity(spark, str(tmp_path)).count() == 0


def test_sample_is_bounded(spark, docs):
    d = docs(*((i, f"t{i}") for i in range(50)))
    texts, labels = toxicity.labelled_sample(d, frame(spark, *((i, 1, i % 2) for i in range(50))), sample=7)
    assert len(texts) == 14 and labels[:, 1].sum() == 7


def test_columns_that_clash(spark, docs, tmp_path):
    d = docs(*((i, "you idiot loser" if i % 2 else "a calm text") for i in range(40))).withColumnsRenamed({"lang": "toxic", "source": "p_toxic", "n_chars": "quality"})
    labels = frame(spark, *((i, 1, i % 2) for i in range(40))).selectExpr("*", "'x' AS text", "1 AS n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert {r.doc_id: r.toxic for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()} == {i: bool(i % 2) for i in range(40)}


def features(text):
    out = set()
    for w in text.lower().split():
        w = w.strip(toxicity._EDGE)
        if w:
            out |= {crc32(x.encode()) % 2**22 for x in [w] + [w[:n] + "~" for n in (4, 5, 6) if len(w) >= n]}
    return out


def shares(text):
    counts = [sum(c in "#*$%&|<>@^~{}[]\\/_=+" for c in text), len(re.findall("[A-ZÀ-ÖØ-Þ]", text)), len(re.findall("[0-9]", text))]
    return [c / max(len(text), 1) for c in counts]


def test_chain_against_a_plain_one(spark):
    """The same predictions text by text from the definitions; the same choice of features; out-of-fold training."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("text", "quality", "toxic").orderBy("doc_id").limit(240).collect()
    texts, labels = [r.text for r in rows], np.array([[int(r.quality == 0), r.toxic] for r in rows])
    models = toxicity.train_chain(texts, labels)
    got = toxicity.Chain(models).predict(pa.array(texts, pa.large_string()))
    for t, p in zip(texts, got, strict=True):
        extra = shares(t)
        for k, m in enumerate(models):
            z = sum(m.weights[m.features[f]] for f in features(t) if f in m.features) + sum(a * b for a, b in zip(m.weights[len(m.features) :], [*extra, 1.0], strict=True))
            extra.append(1 / (1 + math.exp(-min(30, max(-30, z)))))
            assert p[k] == pytest.approx(extra[-1], abs=1e-9)
    held = [features(t) for t in texts]
    y, n1 = labels[:, 0], int(labels[:, 0].sum())
    n0 = len(y) - n1
    scores = {}
    for f in set().union(*held):
        a, b = (sum(f in h for h, v in zip(held, y, strict=True) if v == c) for c in (1, 0))
        share = (a + b) / len(y)
        z = abs(a / n1 - b / n0) / math.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        if a + b >= toxicity.SUPPORT and z > toxicity.TELLING:
            scores[f] = z
    assert set(models[0].features) == set(scores) or len(models[0].features) == 600
    # the second model's last column is the first one's probability, from models that have not seen the text
    fold = np.arange(len(texts)) % toxicity.FOLDS
    out = np.zeros(len(texts))
    for f in range(toxicity.FOLDS):
        part = toxicity.train_chain([t for t, k in zip(texts, fold, strict=True) if k != f], labels[fold != f][:, :1])
        out[fold == f] = toxicity.Chain(part).predict(pa.array([t for t, k in zip(texts, fold, strict=True) if k == f], pa.large_string()))[:, 0]
    rows_ = toxicity._Rows(pa.array(texts, pa.large_string()))
    second = toxicity._train(rows_, np.c_[rows_.extra, out], labels[:, 1].astype(float), np.ones(len(texts), dtype=bool))
    assert second.features == models[1].features and second.weights == pytest.approx(models[1].weights)


def test_training_holds_little_at_once():
    """Features are computed run by run, with the same results, and counts of 4 million features are few at a time."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join([*(f"word{i}" for i in rng.integers(0, 3000, 400)), *["idiot"] * (k % 2)]) for k in range(300)] + ["", "  "]
    labels = np.arange(302) % 2
    whole, runs = toxicity._Rows(pa.array(texts, pa.large_string())), toxicity._Rows(pa.array(texts, pa.large_string()), block=50_000)
    assert len(runs.parts) > 10 and runs.row.tolist() == whole.row.tolist() and runs.feature.tolist() == whole.feature.tolist() and (runs.extra == whole.extra).all()
    telling = np.arange(toxicity.MASK + 1) % 3 == 0
    assert (runs.occurrences(telling) == whole.occurrences(telling)).all()
    tracemalloc.start()
    toxicity._choose(runs, labels, np.ones(302, dtype=bool))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 * 8 * (toxicity.MASK + 1)
