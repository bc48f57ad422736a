"""Near-duplicates: large mixed buckets against all pairs, repeated and null ids, ids of other types, clashing columns."""

import numpy as np
from pyspark.sql import functions as F

from reciprospark.llm import minhash

from .test_operators import docs, sets_of


def least_of(sets, percent):
    least = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and least[i] != least[j] and 100 * len(a & b) >= percent * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return least


def test_copies_of_one_template_with_many_distances(spark):
    """Many texts of one bucket, most of them in no link with its hub; some only linked with one another."""
    rng = np.random.default_rng(21)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(110):
        own = base.copy()
        for at in rng.choice(len(base), int(rng.integers(0, 10)), replace=False):
            own[at] = f"x{rng.integers(10_000)}"
        texts.append(" ".join(own))
        if rng.random() < 0.3:  # a text's own copy, far from the hub too
            own[int(rng.integers(len(own)))] = "y"
            texts.append(" ".join(own))
    sets = [sets_of(t) for t in texts]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), percent=85).collect()}
    assert [found[i] for i in range(len(texts))] == least_of(sets, 85)


def test_an_id_with_several_texts_links_them(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(0, a), (0, b), (1, a + " x"), (2, b + " x"), (3, "alone here"), (None, a), (None, None), (4, None), (4, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(table, percent=85).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True), (None, None, True), (4, 4, True)}
    kept = [(r.doc_id, r.text) for r in minhash.drop_copies(table, percent=85).collect()]
    assert sorted(kept, key=str) == sorted([(0, a), (3, "alone here"), (None, a), (None, None), (4, None)], key=str)


def test_other_ids_and_clashing_columns(spark):
    long = " ".join(f"v{i % 977} v{i % 1009}" for i in range(12_000))
    texts = [long, long + " end", "some words that stand alone here", None]
    table = docs(spark, texts).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("num"), "text", *[F.lit(1).alias(c) for c in ("id", "print", "sign", "bands", "kept", "key", "component_id", "n")])
    found = {r.num: (r.component_id, r.kept) for r in minhash.near_duplicates(table, id_col="num").collect()}
    assert found == {"d0": ("d0", True), "d1": ("d0", False), "d2": ("d2", True), "d3": ("d3", True)}
    kept = minhash.drop_copies(table, id_col="num")
    assert kept.columns == table.columns and sorted(r.num for r in kept.collect()) == ["d0", "d2", "d3"]
