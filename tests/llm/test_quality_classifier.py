from __future__ import annotations

import zlib

import numpy as np
import pytest
from brevia.llm import quality_classifier as Q
from pyspark.sql import functions as F


def brute_score(model, x):
    """The density difference from full matrices."""
    z = np.clip((x - model.center) / model.scale, -Q.CLIP, Q.CLIP)
    log = []
    for c in (0, 1):
        lower = np.linalg.inv(model.factors[c])
        cov = lower @ lower.T
        apart = z - model.means[c]
        log.append(model.offsets[c] - 0.5 * apart @ np.linalg.solve(cov, apart))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def test_scores_equal_full_matrices():
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(0, 1, (300, 5)), draw.normal(1, 2, (100, 5))])
    y = np.repeat([1, 0], [300, 100])
    model = Q.fit_rows(x, y)
    assert np.allclose(model.score(x), [brute_score(model, row) for row in x])
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.85


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0]])
def test_one_class_or_none(labels):
    model = Q.fit_rows(np.zeros((len(labels), 4)), np.array(labels, int))
    assert model.score(np.ones((2, 4))).tolist() == [np.mean(labels) if labels else 0.5] * 2


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op6_quality_classifier(spark, sf_dir).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for k, r in rows.items())
    held = [(rows[k].predicted, y) for k, y in labels.items() if rows[k].held_out]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.95


def test_held_out_labels_are_not_learnt_from(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lie = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == Q.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, lie)
    assert (a.means == b.means).all() and (a.factors == b.factors).all()


def test_filter_and_odd_tables(spark):
    schema = "doc_id long, text string, score string, held_out int, y int"
    good, bad = "The end of the road is here. And this is for you." * 9, "X$$$ Y&&& Z%%% " * 30
    rows = [(k, (good if k % 2 else bad) + str(k), "s", 0, 0) for k in range(60)] + [(None, good, None, None, None), (200, None, None, None, None), (201, "", None, None, None), (1, good, None, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1), (None, 1), (3, None), (500, 1)], "doc_id long, quality int")
    kept = Q.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {k for k in range(60) if k % 2} <= {r.doc_id for r in kept.collect()} <= {k for k in range(60) if k % 2} | {None, 200, 201}
    model = Q.fit(docs, labels)
    assert Q.score(docs, model).count() == len(rows)
    assert Q.score(docs.filter(F.lit(False)), model).count() == 0
    nothing = Q.fit(docs, labels.filter(F.lit(False)))
    assert {r.score for r in Q.score(docs, nothing).collect()} == {0.5}


def test_fit_equals_plain_formulas():
    """Clipped scores, class means, shrunk and ridged covariances and densities, element by element."""
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(0, 1, (80, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]), draw.normal(1, 3, (40, 3))])
    x[5, 0] = 1e6
    y = np.repeat([1, 0], [80, 40])
    n, d = x.shape
    center = [sum(x[:, j]) / n for j in range(d)]
    scale = [(sum((v - center[j]) ** 2 for v in x[:, j]) / n) ** 0.5 for j in range(d)]
    z = np.array([[min(Q.CLIP, max(-Q.CLIP, (row[j] - center[j]) / scale[j])) for j in range(d)] for row in x])
    means, spread, share = {}, {}, {}
    for c in (0, 1):
        rows = [row for row, label in zip(z, y, strict=True) if label == c]
        share[c] = len(rows) / n
        means[c] = [sum(r[j] for r in rows) / len(rows) for j in range(d)]
        spread[c] = np.array([[sum((r[i] - means[c][i]) * (r[j] - means[c][j]) for r in rows) / len(rows) for j in range(d)] for i in range(d)])
    log = {}
    for c in (0, 1):
        cov = (1 - Q.SHRINK) * spread[c] + Q.SHRINK * (share[0] * spread[0] + share[1] * spread[1])
        cov = (1 - Q.RIDGE) * cov + Q.RIDGE * sum(cov[j][j] for j in range(d)) / d * np.eye(d) + 1e-6 * np.eye(d)
        log[c] = [np.log(share[c]) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * (row - means[c]) @ np.linalg.solve(cov, row - means[c]) for row in z]
    want = [1 / (1 + np.exp(a - b)) for a, b in zip(log[0], log[1], strict=True)]
    assert np.allclose(Q.fit_rows(x, y).score(x), want, atol=1e-8)


def test_features_equal_plain_formulas():
    import pyarrow as pa
    from brevia.llm.textkit import column_stats

    text = "The cat and the dog sat. THE END!\nthe cat and the dog sat. 1 2 3\n\n#"
    s = {k: int(v[0]) for k, v in column_stats(pa.array([text])).items()}
    words, letters = text.split(), sum(c.isalpha() for c in text)
    assert (s["n_words"], s["n_letters"], s["n_distinct"], s["n_lines"], s["n_digits"], s["n_upper"]) == (len(words), letters, len(set(words)), 3, 3, 7)
    want = [
        np.log(1 + len(words)), np.log(1 + sum(map(len, words)) / len(words)), np.log(1 + len(words) / 3), np.log(0.02 + 1 / len(words)), np.log(0.02 + 1 / len(words)), (s["n_repeat_words"] / len(words)) ** 0.5, 0.0,
        (s["n_stop"] / len(words)) ** 0.5, (len(set(words)) / len(words)) ** 0.5, np.log(0.02 + 7 / letters), np.log(0.02 + 3 / len(text)), letters / len(text), 1 / 3,
    ]
    assert np.allclose(Q.features(column_stats(pa.array([text])))[0], want)
