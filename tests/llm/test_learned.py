"""The classifier, the suffix tree and the pipeline."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martloom.llm import classifier, queries, suffix_tree

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@needs_data
def test_classifier_on_the_held_out_fold(spark):
    got = queries.op5_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    both = got[got.held_out].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_classifier_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.score(docs, none, F.lit(True), buckets=64, dims=4).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    assert classifier.score(empty, none, F.lit(True), buckets=64, dims=4).count() == 0
    some = spark.createDataFrame([(1, 1), (7, 0), (10, 1), (14, 0), (12, None)], "doc_id long, quality int")
    got = classifier.score(docs, some, F.lit(True), buckets=64, dims=4, epochs=3).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()


def test_temperature_makes_scores_calibrated():
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (4000, 5))
    y = (r.random(4000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    p = classifier.Network(x, y)(x)
    for low, high in ((0.2, 0.4), (0.4, 0.6), (0.6, 0.8)):
        some = (p > low) & (p <= high)
        assert abs(p[some].mean() - y[some].mean()) < 0.08


def tokens_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text.translate(LOW)) + ["\r"]


def test_base_scores(docs, texts, empty):
    train = F.col("doc_id") % 4 != 0
    got = suffix_tree.score(docs, train).collect()
    assert len(got) == len(texts)
    learned = Counter(w for i, t in texts if i is not None and math.fmod(i, 4) != 0 for w in tokens_of(t))
    n, v = sum(learned.values()), len(learned)
    for r in got:
        words = tokens_of(dict(texts)[r.doc_id])
        base = sum(math.log10((learned[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(learned[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and -1e9 < r.score < 0
        assert r.held_out == (r.doc_id is None or math.fmod(r.doc_id, 4) == 0)
    assert suffix_tree.score(empty, F.lit(True)).count() == 0
    untrained = suffix_tree.score(docs.filter("doc_id = 5"), F.lit(False)).first()
    assert untrained.train_tokens == 0 and untrained.score < 0


def test_common_words_do_not_change_scores(docs):
    rows = lambda c: sorted((str(r.doc_id), r.n_known, round(r.score, 6)) for r in suffix_tree.score(docs, F.lit(True), common=c).collect())
    assert rows(1) == rows(50) == rows(100_000)


def test_tree_is_a_distribution(spark):
    words = {"the": 50, "then": 20, "other": 9, "be": 30, "\r": 5, "e\nbe": 30, "e\nth": 20, "\t\nth": 15}
    df = spark.createDataFrame(list(words.items()), "word string, c long")
    model = suffix_tree.packed(suffix_tree.tree(df, depth=3, nats=0.5))
    assert len(model["ctx"]) > 3
    alphabet = sorted({c for w in words for c in suffix_tree.marked(w)} | {"q"})
    for prefix in ("\tth", "\tqq", "\tothe", "\t"):
        p = []
        for c in alphabet:
            symbols, _, contexts = suffix_tree.positions([prefix + c], 3)
            p.append(10 ** suffix_tree._smoothed(np.full(len(symbols), 1 / suffix_tree.CODE_POINTS), symbols, contexts, model)[-1])
        rest = p[alphabet.index("q")] * (suffix_tree.CODE_POINTS - len(alphabet))
        assert sum(p) + rest == pytest.approx(1, abs=1e-9)


@needs_data
def test_tree_beats_counts_on_text_like_its_own(spark):
    got = queries.op8_suffix_tree_scores(spark, SF).toPandas()
    seen = got[~got.held_out]
    assert seen.score.sum() > seen.base_score.sum()


@needs_data
def test_pipeline_stages(spark):
    """Each stage against the operator's own verdicts, whose brute force is beside."""
    from martloom.llm import quality, secrets, simhash

    small = SF.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, small).cache()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    single = stages["simhash near-dedup"](spark, good, small).cache()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.groups(good).collect()}
    clean = stages["secret scans"](spark, single, small).cache()
    assert clean.count() == single.count() and secrets.labelled(
        secrets.described(secrets.candidates(clean), secrets.dictionary(clean))).filter("label = 1").count() == 0
    mixed = stages["source mixing"](spark, clean, small).cache()
    assert mixed.columns == docs.columns and 0.8 * clean.count() < mixed.count() <= clean.count()
    pieces = corpus_pipeline.run(spark, small).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in mixed.collect()}
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    """Nulls, empty and repeated rows, and extra columns through every stage."""
    odd = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, "").cache()
        assert odd.columns == docs.columns, name
    left = {r.doc_id for r in odd.collect()}
    assert left <= {1, 7, 10, 11, 12, 13, 14, 9, None, 2**62, -5} and len(left) > 5
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() > 0


def test_pipeline_of_nothing(spark, empty):
    none = empty
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0
