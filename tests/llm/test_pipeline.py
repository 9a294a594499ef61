from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brevia.llm import quality_classifier, quality_rules, simhash_dedup, source_mixing
from brevia.llm.textkit import column_stats
from tests.llm.test_simhash_dedup import brute_components, brute_print, shingles


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return {name: x for (name, _), x in zip(P.STAGES, out, strict=True)}


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_columns_and_run(spark, sf_dir, steps):
    for before, after in list(steps.values())[:-1]:
        assert before.columns == after.columns and 0 < after.count()
    assert plain(P.run(spark, sf_dir)) == plain(steps["sentencepiece"][1])


def test_quality_rules(steps):
    before, after = (x.toPandas() for x in steps["quality_rules"])
    stats = column_stats(pa.array(before.text))
    found = quality_rules.votes(stats)
    model = quality_rules.fit_counts(*np.unique(quality_rules.pattern(found), return_counts=True))
    failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
    assert sorted(after.doc_id) == sorted(before.doc_id[~failed & (model.posterior(found) >= 0.5)])


def test_quality_classifier(spark, sf_dir, steps):
    before, after = (x.toPandas() for x in steps["quality_classifier"])
    model = quality_classifier.fit(steps["quality_classifier"][0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = model.score(quality_classifier.features(column_stats(pa.array(before.text))))
    assert sorted(after.doc_id) == sorted(before.doc_id[score >= 0.5])


def test_simhash_dedup(steps):
    """One document of each group: fingerprints at 4 or fewer of 64 bits, or 0.8 or more of the five-word shingles."""
    before, after = (x.toPandas().sort_values("doc_id", ignore_index=True) for x in steps["simhash_dedup"])
    prints = np.array([brute_print(t) for t in before.text], np.uint64)
    sets = [shingles(t) for t in before.text]
    alike = np.array([[bool(a) and 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    near = alike | (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash_dedup.RADIUS)
    assert near.sum() > len(near)
    assert after.doc_id.tolist() == before.doc_id[np.unique(brute_components(near))].tolist()


def test_source_mixing(steps):
    before, after = steps["source_mixing"]
    drawn = source_mixing.select(before, source_mixing.Mix()).collect()
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in drawn)
    whole = {r.doc_id: r.text for r in before.collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in after.collect())


def test_sentencepiece(steps):
    before, after = steps["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, tuple(library.encode(r.text))) for r in before.collect())
    assert want == Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) and after.filter("not round_trip").count() == 0


def test_odd_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
    assert simhash_dedup.label(docs).count() == 0


def test_rows_of_every_kind(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, shared and null keys, and columns named as inside the stages."""
    from pyspark.sql import functions as F

    good = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(12).collect()]
    long = " ".join(f"{w}{k}" for k in range(40) for w in good[0].split())
    rows = [(k, t, "en", "web") for k, t in enumerate(good)]
    rows += [(3, good[3], "en", "web"), (4, good[5], "en", "web"), (None, good[6], None, None), (None, None, "en", "web"), (90, "", "", ""), (91, None, None, None), (92, long, "en", "web"), (93, good[7], "en", "web")]
    names = ["score", "kept", "fp", "component_id", "root", "n", "txt", "rank", "leaf", "epoch", "n_words", "ids"]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[None] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names))
    sizes = []
    for name, stage in P.STAGES:
        after = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert after.columns == docs.columns, name
        after.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/kinds-{name}")
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name == "quality_rules":
            assert docs.filter(F.coalesce("text", F.lit("")) == "").count() == 0
        if name == "simhash_dedup":
            assert docs.count() == docs.select("text").distinct().count()
    assert all(sizes[:3])
