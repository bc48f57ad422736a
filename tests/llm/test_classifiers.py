"""The classifiers' inner values against brute force, and their defined cases."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reciprospark.llm import bytewords, quality, toxicity

from .test_operators import DOCS, docs

TEXTS = [None, "", " .,;", "Héllo, hello HELLO! wörld-wide x", "a\nb  c3d,e", "one two three " * 50, "1x" * 4000 + " end", "tail"]


def plain_words(text):
    fold = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", fold)


def plain_bag(word, before, after):
    """Hash buckets of the n-grams of a word with a border where there is one."""
    own = b" " * before + word + b" " * after
    out = []
    for size in toxicity.SIZES:
        for k in range(len(own) - size + 1):
            h = sum(int(bytewords._BYTE_CODE[c]) * int(toxicity._SPICE[j]) for j, c in enumerate(own[k : k + size])) % 2**64
            out.append(((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % 2**64) >> 47)
    return sorted(out)


def test_bags_against_brute_force():
    own, flat, size = toxicity.bags(TEXTS)
    assert [len(o) for o in own] == [len(set(plain_words(t))) for t in TEXTS]
    at = np.cumsum(size) - size
    text = "xx abcd yy"
    alone, flat, size = toxicity.bags([text])
    at = np.cumsum(size) - size
    got = sorted(sorted(flat[a : a + n].tolist()) for a, n in zip(at, size))
    assert got == sorted([plain_bag(b"xx", 0, 1), plain_bag(b"abcd", 1, 1), plain_bag(b"yy", 1, 0)])


def test_scores_against_brute_force():
    rng = np.random.default_rng(3)
    numbers = rng.standard_normal(toxicity.BUCKETS).astype(np.float32)
    heights = np.array([-0.3, -0.2, 0.0, 0.2, 0.4])
    layer = rng.standard_normal((3, 8))
    layer[1] = np.abs(layer[1]) + 0.5
    layer[0, -1], layer[1, -1] = 0, 1
    model = toxicity.Model.unpacked(toxicity.Model(numbers, 0.1, heights, layer).packed())
    texts = ["alpha beta gamma delta BETA epsilon", "x", "", None, "one two three four five six seven"]
    got = np.concatenate([toxicity.judged(p, model) for p in bytewords.text_slices(pa.array(texts, pa.string()))])
    for t, score in zip(texts, got):
        words, total, count = plain_words(t), {}, {}
        for k, w in enumerate(words):
            bag = plain_bag(w, k > 0, k < len(words) - 1)
            total[w], count[w] = float(numbers[bag].sum()), len(bag)
        own = sorted((v for w in total for v in [total[w] / max(1, count[w]) + 0.1] if v > heights[0]), reverse=True)
        x = [np.log1p(sum(max(0, v - h) for v in own)) for h in heights[1:]] + (own + [heights[0]] * 3)[:3] + [1]
        assert score == pytest.approx(1 / (1 + np.exp(-((np.array(x) - layer[0]) / layer[1]) @ layer[2])), abs=1e-5)


def test_pooling_against_brute_force():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    for part in bytewords.text_slices(pa.array(TEXTS, pa.string())):
        got, (ids, bounds) = quality.pooled(part, vectors), quality.tokens(part)
        for k in range(len(part.starts)):
            raw = part.data[part.starts[k] : part.ends[k]].tobytes()
            assert bounds[k + 1] - bounds[k] == len(re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x20\x09-\x0d]", raw))
            v = vectors[ids[bounds[k] : bounds[k + 1]]]
            want = np.concatenate([v.mean(0), v.std(0), (v[:-1] * v[1:]).sum(0) / len(v)]) if len(v) else np.zeros(3 * quality.DIMENSIONS)
            assert got[k] == pytest.approx(want, abs=2e-3)


def test_word_vectors_against_brute_force(spark):
    texts = ["red blue red green", "blue", None, "green red"]
    got = quality.word_vectors(docs(spark, texts).repartition(3))
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for part in bytewords.text_slices(pa.array(texts, pa.string())):
        ids, bounds = quality.tokens(part)
        for lo, hi in zip(bounds, bounds[1:]):
            for i in range(lo, hi):
                for j in range(max(lo, i - quality.REACH), min(hi, i + quality.REACH + 1)):
                    if i != j:
                        sums[ids[i], quality._PLACES[ids[j]]] += quality._SIGNS[ids[j]]
    assert got == pytest.approx(sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), abs=1e-6)


def test_defined_cases_of_both_classifiers(spark):
    bad = "gromple grompled gromplish"
    rows = [(i, f"river stone {'cloud ' * 20}{bad if i % 3 == 0 else 'house walk light'}") for i in range(90)]
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows + rows[:5]], "doc_id long, text string, label int, x string, labelled_id int").withColumnsRenamed({"doc_id": "score"})
    marks = [(i, i % 3 == 0) for i in range(90)] + [(i, False) for i in range(0, 90, 3)] + [(7, None), (None, True)]  # of conflicting labels the greatest counts
    labels = spark.createDataFrame([(i, None if y is None else int(y)) for i, y in marks], "score long, toxic int").withColumn("quality", F.col("toxic"))
    long = spark.createDataFrame([(1, "walk " * 60_000 + bad), (2, "walk " * 60_000), (2, "walk " * 60_000), (3, None), (4, ""), (None, bad)], "score long, text string")
    model = toxicity.fitted(table, labels, trains=lambda i: i >= 0, id_col="score")
    vectors = quality.word_vectors(table)
    network = quality.fitted(table, labels, vectors, trains=lambda i: i >= 0, id_col="score")
    for found in (toxicity.scores(long, model, id_col="score"), quality.scores(long, vectors, network, id_col="score")):
        assert found.columns == ["score", "score_"]
        got = found.collect()
        assert len(got) == 6 and len({round(r.score_, 9) for r in got if r.score == 2}) == 1 and len({round(r.score_, 9) for r in got if r.score in (3, 4)}) == 1
        assert all(0 <= r.score_ <= 1 for r in got)
    by = {r.score: r.score_ for r in toxicity.scores(long, model, id_col="score").collect()}
    assert by[1] > 0.5 > by[2] and by[None] > 0.5
    assert [r.score for r in toxicity.drop_toxic(long, model).collect()] == [2, 2, 3, 4]
    empty = long.filter("false")
    assert toxicity.scores(empty, model, id_col="score").count() == 0 and quality.scores(empty, vectors, network, id_col="score").count() == 0
    assert not quality.word_vectors(docs(spark, ["x"]).filter("false")).any()
    assert toxicity.fitted(spark.createDataFrame([], DOCS), labels.withColumnRenamed("score", "doc_id"), trains=lambda i: i >= 0).layer is None
