"""Exact joins of sets: groups of common first members against all pairs, templates, hot members; the n-gram join against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reciprospark.llm import ngram_join, overlap
from reciprospark.llm.storage import Scratch

from .test_minhash import least_of
from .test_operators import docs


def shingles(text, size):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split() if w]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def table_of(spark, sets, c=None):
    return spark.createDataFrame([(i, i if c is None else c[i], [hash((7, t)) for t in s]) for i, s in enumerate(sets)], "num long, c long, set array<long>")


def similar(sets, percent, c=None):
    return {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and (c is None or c[i] != c[j])}


def found_pairs(spark, sets, percent, c=None):
    scratch = Scratch()
    rows = overlap.incidence(table_of(spark, sets, c), percent, scratch)
    met = {tuple(r) for r in overlap.pairs(rows, percent, scratch).collect()}
    kept = {tuple(r) for r in overlap.product(spark.createDataFrame([*met], "u long, v long"), rows, percent).collect()} if met else set()
    scratch.clear()
    return met, kept


def template(n, rng, slots=4, alternatives=12):
    """Distinct texts of one template of 36 words; texts that differ in one slot have too little in common for a link."""
    out = set()
    while len(out) < n:
        own = [f"f{i}" for i in range(36)]
        for s in range(slots):
            own[4 + 8 * s] = f"s{s}x{rng.integers(alternatives)}"
        out.add(" ".join(own))
    return sorted(out)


@pytest.mark.parametrize("percent", [80, 85])
def test_families_of_many_distances(spark, percent):
    rng = np.random.default_rng(percent)
    sets = []
    for family in range(6):
        base = [f"{family}-{i}" for i in range(int(rng.integers(1, 90)))]
        for _ in range(30):
            own = {t for t in base if rng.random() > rng.choice([0.0, 0.02, 0.1])} | {f"own{rng.integers(10**9)}" for _ in range(int(rng.integers(0, 1 + len(base) // 8)))}
            sets.append(own | ({f"0-{i}" for i in range(30)} if rng.random() < 0.2 else set()))
    c = [int(x) for x in rng.integers(0, 40, len(sets))]
    met, kept = found_pairs(spark, sets, percent, c)
    assert kept == similar(sets, percent, c) and kept and kept <= met


def test_pairs_of_a_template_grow_with_its_texts(spark):
    rng = np.random.default_rng(1)
    for n in (1000, 4000):
        sets = [shingles(t, 5) for t in template(n, rng)]
        assert len(found_pairs(spark, sets, 80)[0]) <= 20 * n
    assert not similar(sets[:300], 80)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=40), st.sampled_from([60, 80, 85]))
def test_small_random_sets(spark, sets, percent):
    assert found_pairs(spark, sets, percent)[1] == similar(sets, percent)


def joined(spark, table, percent=85, **names):
    return {r[0]: tuple(r[1:]) for r in ngram_join.join(table, percent, **names).collect()}


def test_query_against_all_pairs(spark):
    from reciprospark.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    ids, sets = [r.doc_id for r in table], [shingles(r.text, 4) for r in table]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op11_ngram_join(spark, "/root/testdata/sf0.01").collect()}
    order = np.argsort(ids)
    least = least_of([sets[i] for i in order], 85)
    assert found == {ids[i]: (len(sets[i]), ids[order[least[k]]]) for k, i in enumerate(order)}
    assert sum(i != c for i, (_, c) in found.items()) > 20


@pytest.mark.parametrize("percent", [80, 85])
def test_join_of_near_copies(spark, percent):
    rng = np.random.default_rng(8)
    texts = []
    for family in range(4):
        base = [f"w{family}-{i}" for i in range(90)]
        for _ in range(30):
            own = base.copy()
            for at in rng.choice(len(base), int(rng.integers(0, 6)), replace=False):
                own[at] = f"x{rng.integers(50)}"
            texts.append(" ".join(own))
    texts += template(60, rng) + ["one", "One", "one two", "", None, " \t", "a b c", "a  B\nc", "long " * 30_000, "long " * 29_000 + "end of it"]
    rng.shuffle(texts)
    found = joined(spark, docs(spark, texts), percent)
    sets = [shingles(t, 4) for t in texts]
    assert [found[i] for i in range(len(texts))] == list(zip(map(len, sets), least_of(sets, percent)))


def test_join_of_repeated_null_and_text_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [("0", a), ("0", b), ("1", a + " x"), ("2", b + " x"), ("3", "alone here"), (None, a), (None, None), ("4", None), ("4", "")]
    table = spark.createDataFrame(rows, "n_shingles string, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "num", "h", "c", "set", "component_id")])
    found = ngram_join.join(table, 85, id_col="n_shingles")
    assert found.columns == ["n_shingles", "n_shingles_", "component_id"]
    assert sorted((str(r.n_shingles), str(r.component_id)) for r in found.collect()) == [("0", "0"), ("0", "0"), ("1", "0"), ("2", "0"), ("3", "3"), ("4", "4"), ("4", "4"), ("None", "None"), ("None", "None")]
    assert ngram_join.join(table.filter("false"), 85, id_col="n_shingles").count() == 0
