"""What Python workers hold when an operator's task has ended or another operator's begins."""

import gc
import re
import subprocess
import sys

import numpy as np
import public_tokenizers

from reciprospark.llm import spm, toxicity

from .test_operators import DOCS

FREED = """
import numpy as np
from reciprospark.llm.workers import lean
own = lambda: int(next(x.split()[1] for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:"))) // 1024
pins = []
def run(batches):
    blocks = [np.ones(12_000) for _ in range(1500)]  # below the size that is mapped apart
    pins.append(np.ones(12_000))  # keeps the heap from shrinking by itself
    del blocks
    yield own()
before = own()
freed = list(lean(run)(iter([])))[0] - before
print(freed, own() - before)
"""


def test_freed_memory_goes_back_to_the_system():
    done = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True)
    held, after = map(int, done.stdout.split())
    assert held > 100 and after < 20


def test_tables_of_another_operator_go(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "s", 1) for i in range(64)], DOCS).repartition(8)
    assert spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 64

    class Watching(toxicity.Model):
        @property
        def layer(self):
            assert not any(isinstance(x, spm.PrefixTable) for x in gc.get_objects())
            return None

        @layer.setter
        def layer(self, value):
            pass

    assert toxicity.drop_toxic(docs, Watching()).count() == 64


def test_distinct_words_of_a_sample_by_slice():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, n)) for n in rng.integers(1, 400, 700)] + ["", None, "  ", "w1"]
    assert sum(len(t or "") for t in texts) > 2 * toxicity.bw.SLICE_BYTES
    words = [set(re.findall(r"\w+", t or "")) for t in texts]
    own, flat, size = toxicity.bags(texts)
    assert len(size) == len(set().union(*words)) and len(flat) == size.sum()
    assert [len(o) for o in own] == [len(w) for w in words]
    place = {}
    for o, w in zip(own, words):
        assert (np.diff(o) > 0).all()
        for word in w:
            place.setdefault(word, set(o.tolist())).intersection_update(o.tolist())
    assert all(place.values())
