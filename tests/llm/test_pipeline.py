"""The corpus pipeline against brute force, with near copies between 0.80 and 0.85."""

import numpy as np

import corpus_pipeline
from reciprospark.llm import minhash

from .test_operators import DOCS, sets_of


def similar(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}n" for a in ("ba", "ke", "li", "mo", "su", "ta", "ro", "vi") for b in ("lat", "nor", "pim", "red", "sol", "tur", "wen", "zik")]
    plain = lambda n: [str(w) for w in rng.choice(vocabulary + ["the", "of"] * 6, n)]
    texts, toxic, leaks = [], set(), set()
    for _ in range(40):  # a text and one with four words changed: 180 shingles of 220
        base = plain(204)
        own = base.copy()
        for at in (20, 70, 120, 170):
            own[at] = f"new{at}"
        texts += [" ".join(base), " ".join(own)]
    for _ in range(60):
        toxic.add(len(texts))
        texts.append(" ".join(plain(20) + ["gromple"] + plain(30) + ["grompled"] + plain(20)))
    texts += [" ".join(plain(80)) for _ in range(60)]
    item = plain(25) + ["answer"] + plain(6)
    leaks.add(len(texts))
    texts.append(" ".join(plain(60) + item + plain(60)))
    texts += ["too short", "", None]
    sets = [sets_of(t) for t in texts]
    planted = [similar(sets[2 * k], sets[2 * k + 1]) for k in range(40)]
    assert all(0.80 <= p < 0.85 for p in planted)
    good = [i for i, t in enumerate(texts) if len((t or "").split()) >= 50 and i not in toxic]
    least = {i: i for i in good}
    for i in good:
        for j in good:
            if j < i and similar(sets[i], sets[j]) >= 0.8:
                least[i] = min(least[i], least[j])
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(len(texts))], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, f"{' '.join(item[:25])}. {' '.join(item[25:])}.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()]
    assert sorted(got) == [i for i in good if least[i] == i and i not in leaks]


def test_bands_find_single_links_at_the_asked_similarity():
    assert minhash.layout(85) == (21, 6)
    rng = np.random.default_rng(9)
    for percent, common, own in ((80, 200, 25), (85, 204, 18)):
        pairs = [rng.integers(0, 2**64, common + 2 * own, dtype=np.uint64) for _ in range(4000)]
        u, v = (np.stack([minhash.signature(s) for s in side]) for side in ([p[own:] for p in pairs], [p[: common + own] for p in pairs]))
        met = (minhash.band_keys(u, percent) == minhash.band_keys(v, percent)).any(1)
        assert (~met).sum() <= 1
