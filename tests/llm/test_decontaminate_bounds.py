"""The bounds of the decontamination index: its size, and results that don't depend on the number of passes."""

import pickle

import numpy as np

from reciprospark.llm import decontaminate

from .test_operators import docs


def test_index_grows_with_the_words_alone():
    rng = np.random.default_rng(10)
    index = decontaminate.Index.of([(k, " ".join(f"w{i}" for i in rng.integers(0, 60_000, 30)), "answer") for k in range(4000)])
    assert len(index.terms) > 40_000
    assert len(pickle.dumps(index)) < 100 * 4000 * 31


def test_leaks_dont_depend_on_the_number_of_passes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(2000)]
    body = lambda n: [str(w) for w in np.where(rng.random(n) < 0.5, rng.choice(common, n), rng.choice(rare, n))]
    items = [(k, " ".join(body(int(rng.integers(10, 90)))) + ". " + " ".join(body(8)) + ".") for k in range(60)]
    texts = [None, ""]
    for k in range(0, 60, 2):  # whole items and such with words changed, so that scores lie about the threshold
        own = items[k][1].split()
        for at in rng.choice(len(own), k // 6, replace=False) if len(own) > k // 6 else ():
            own[at] = "changed"
        texts.append(" ".join(body(100) + own + body(100)))
    table = spark.createDataFrame(items, "item_id long, text string")
    find = lambda: sorted(tuple(r) for r in decontaminate.find_leaks(docs(spark, texts), table, question=0.3, answer=0.3).collect())
    kept = lambda: sorted(r.doc_id for r in decontaminate.drop_leaking(docs(spark, texts), table).collect())
    whole, stay = find(), kept()
    assert len(whole) >= 10
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 9)
    assert find() == whole and kept() == stay
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 20_000)
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 500, raising=False)
    assert find() == whole and kept() == stay
