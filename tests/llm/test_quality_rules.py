from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brevia.llm import quality_rules as Q
from brevia.llm import textkit as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_chars": len(text), "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct": len(set(words)),
        "n_stop": sum(w in set(T.STOP_WORDS) for w in words),
    }


EDGES = [None, "", "\n", "a\n", "a\n\n", "\na", "a b c a b c", "\n\n", "x\na\nx", " é ñ b", "\x1c\x1d a", "日本 　 語", "same\r\nsame\r\nsame"]


def test_statistics_equal_brute_force():
    draw = random.Random(3)
    texts = EDGES + ["".join(draw.choice("ab \n\té#.") for _ in range(draw.randint(0, 60))) for _ in range(2000)] + ["word " * 50_000]
    found = T.column_stats(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        for name, value in brute(text).items():
            assert found[name][i] == value, (name, i, text)


def test_sliced_arrow_columns():
    texts = pa.array(["a b", None, "c\nc", "d"], pa.string())
    assert T.column_stats(texts.slice(1, 2))["n_words"].tolist() == [0, 2]


def test_em_finds_reliable_rules():
    draw = np.random.default_rng(0)
    good = draw.random(20_000) < 0.9
    found = np.zeros((len(good), len(Q.RULES)), bool)
    for k, vote in enumerate(Q.VOTE):
        right = good if vote > 0 else ~good
        found[:, k] = np.where(right, draw.random(len(good)) < 0.9, draw.random(len(good)) < 0.02)
    codes, n = np.unique(Q.pattern(found), return_counts=True)
    model = Q.fit_counts(codes, n)
    assert ((model.posterior(found) >= 0.5) == good).mean() > 0.99
    assert (Q.unpack(Q.pattern(found)) == found).all()


def test_score_and_filter_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = Q.score(docs).toPandas().set_index("doc_id")
    kept = {r.doc_id for r in Q.filter_documents(docs).select("doc_id").collect()}
    assert kept == set(scored.index[scored.kept]) and 0 < len(kept) < len(scored)
    for r in docs.collect():
        have, want = scored.loc[r.doc_id], brute(r.text)
        assert all(have[c] == want[c] for c in Q.BASE)
        assert have.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality.rename("label")
    judged = scored.join(labels, how="inner")
    judged = judged[~judged.base_failed]
    assert (judged.kept == (judged.label == 1)).mean() > 0.95


def test_odd_tables(spark):
    schema = "doc_id long, text string, kept string, code int, quality int"
    rows = [(1, None, "x", 1, 2), (None, "a " * 60, None, None, None), (2, "", "", 0, 0), (2, "", "", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    assert [r.base_failed for r in Q.score(docs).orderBy("n_words").collect()] == [True] * 4
    assert Q.filter_documents(docs).columns == docs.columns
    empty = spark.createDataFrame([], schema)
    assert Q.score(empty).count() == 0 and Q.filter_documents(empty).count() == 0


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_chunks_cover_all_documents(n):
    offsets = np.concatenate([[0], np.cumsum(np.random.default_rng(n).integers(0, 50, n))])
    data = np.zeros(offsets[-1], np.uint8)
    spans = [(a, b) for a, b, _, _ in T.chunks(data, offsets, 64)]
    assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def brute_stats(text):
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return brute(text) | {
        "n_letters": sum(c.isascii() and c.isalpha() or not c.isascii() for c in text), "n_upper": sum("A" <= c <= "Z" for c in text), "n_loud": text.count("!"),
        "n_final_lines": sum(WORD.findall(x)[-1][-1] in ".!?:;\"')" for x in lines),
    }


def brute_verdicts(texts):
    """Votes, accuracies and posteriors, document by document and rule by rule."""
    rows = []
    for text in texts:
        s, row = brute_stats(text), {}
        for name, vote, top, bottom, low, high in Q.RULES:
            if s[bottom] and low <= s[top] / s[bottom] < high:
                row[name] = vote
        rows.append(row)
    accuracy = {rule[0]: 0.85 for rule in Q.RULES}

    def posterior(row):
        odds = 1.0
        for name, vote in row.items():
            odds *= (accuracy[name] / (1 - accuracy[name])) ** vote
        return odds / (1 + odds)

    for _ in range(200):
        good = [posterior(row) for row in rows]
        new = {}
        for name in accuracy:
            fired = [(row[name], p) for row, p in zip(rows, good, strict=True) if name in row]
            new[name] = max(0.5, (sum(p if vote > 0 else 1 - p for vote, p in fired) + 0.85) / (len(fired) + 1))
        moved = max(abs(new[name] - accuracy[name]) for name in new)
        accuracy = new
        if moved < 1e-9:
            break
    return [posterior(row) for row in rows]


def test_verdicts_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = brute_verdicts([r.text for r in docs])
    found = {r.doc_id: r for r in Q.op3_quality_rules(spark, sf_dir).collect()}
    assert all(abs(found[r.doc_id].quality - p) < 1e-6 for r, p in zip(docs, want, strict=True))
    assert all(found[r.doc_id].kept == (not found[r.doc_id].base_failed and p >= 0.5) for r, p in zip(docs, want, strict=True))
    assert 0.1 < np.mean([p >= 0.5 for p in want]) < 1
