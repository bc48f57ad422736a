"""URL rules and language-model ratios against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reciprospark.llm import urls

URLS = [None, "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.net/enx", "https://badexample.net", "ftp://x.org/fr/a", "http://net/", "http://a.example.com/de/", "http://a.example.com/fr/p", "x://h?/a/b", "http://a://b/c"]


def test_url_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = [(r.host, r.path, r.rule) for r in urls.url_filter(rows).orderBy("page_id").collect()]
    assert got == [("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/enx", "net/"), ("badexample.net", "", None), ("x.org", "/fr/a", "org/fr/"), ("net", "/", "net/"), ("a.example.com", "/de/", "example.com/de/"), ("a.example.com", "/fr/p", None), ("h", "", None), ("a:", "//b/c", None)]
    assert urls.url_filter(rows.filter("false")).count() == 0


def test_url_model_against_brute_force(spark):
    counts = [("aab", 3, 1), ("abb", 0, 2), ("bab", 1, 1)]
    order, urls.ORDER = urls.ORDER, 2
    try:
        got = {r.gram: r.llr for r in urls.log_ratios(spark.createDataFrame(counts, "gram string, a long, r long"), spark.createDataFrame([("aab",), ("xyb",), ("bac",)], "gram string")).collect()}
    finally:
        urls.ORDER = order

    def chance(gram, column):
        p = 1 / urls.ALPHABET
        for k in range(3):
            table = Counter()
            for g, *n in counts:
                table[g[2 - k :]] += n[column]
            total = sum(n for g, n in table.items() if g[:-1] == gram[2 - k : -1])
            types = sum(n > 0 for g, n in table.items() if g[:-1] == gram[2 - k : -1])
            if total:
                p = (table[gram[2 - k :]] + types * p) / (total + types)
        return p

    for g, llr in got.items():
        assert llr == pytest.approx(np.log(chance(g, 0)) - np.log(chance(g, 1)))


def plain_filter(texts):
    """(rule verdict or null, ratio or null, verdict) by plain Python, for URLs with a host and a path."""
    split = []
    for t in texts:
        rest = (t or "").split("://", 1)[1] if "://" in (t or "") else ""
        host = rest.split("/", 1)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host, rule = host.lower(), None
        for r in urls.RULES:
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (rule is None or len(r.text) > len(rule.text)):
                rule = r
        split.append((host + path, rule and rule.verdict))
    return split


def test_whole_filter_against_brute_force(spark):
    rng = np.random.default_rng(31)
    part = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(3, 9))))
    texts = []
    for k in range(240):
        good = k % 2
        word = part("aeloru" if good else "xzqkwv")
        host = [f"{word}.org", f"{word}.net", f"{word}.com"][k % 3] if k % 4 else f"{word}.info"
        texts.append(f"http://{host}/{'fr' if good else 'de'}/{part('aeiou' if good else 'xzq')}")
    texts += [None, "", texts[0], texts[3], "http://long.info/" + "ab" * 4000]
    table = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    got = {r.page_id: r for r in urls.url_filter(table).collect()}
    split = plain_filter(texts)
    names = {r["s"]: r["n"] for r in spark.createDataFrame([(h.split("/", 1)[0], "/" + h.split("/", 1)[1] if "/" in h else "", h) for h, _ in split], "host string, path string, s string").select("s", F.xxhash64("host", "path").alias("n")).collect()}
    grams = lambda s: [("\x02" * urls.ORDER + s + "\x03")[i : i + urls.ORDER + 1] for i in range(len(s) + 1)]
    held = {s: names[s] % urls.HOLD_OUT == 0 for s, _ in split}
    tables = {v: [Counter() for _ in range(urls.ORDER + 1)] for v in ("allow", "block")}
    for s, verdict in split:
        if verdict and not held[s]:
            for g in grams(s):
                for k in range(urls.ORDER + 1):
                    tables[verdict][k][g[urls.ORDER - k :]] += 1
    totals = {v: [Counter() for _ in t] for v, t in tables.items()}
    types = {v: [Counter() for _ in t] for v, t in tables.items()}
    for v in tables:
        for k, t in enumerate(tables[v]):
            for g, n in t.items():
                totals[v][k][g[:-1]] += n
                types[v][k][g[:-1]] += 1

    def chance(g, v):
        p = 1 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            own = g[urls.ORDER - k :]
            n, t = totals[v][k][own[:-1]], types[v][k][own[:-1]]
            if n:
                p = (tables[v][k][own] + t * p) / (n + t)
        return p

    ratio = {s: float(np.mean([np.log(chance(g, "allow")) - np.log(chance(g, "block")) for g in grams(s)])) for s, _ in split}
    by = {v: np.array([ratio[s] for s, verdict in split if verdict == v and held[s]]) for v in ("allow", "block")}
    pooled = sum(len(x) * x.var() for x in by.values()) / sum(map(len, by.values()))
    slope, middle = (by["allow"].mean() - by["block"].mean()) / max(pooled, 1e-6), (by["allow"].mean() + by["block"].mean()) / 2
    assert slope > 0
    for i, (s, verdict) in enumerate(split):
        if verdict:
            assert (got[i].verdict, got[i].ratio) == (verdict, None)
        else:
            assert got[i].ratio == pytest.approx(ratio[s], abs=1e-9)
            assert got[i].probability == pytest.approx(1 / (1 + np.exp(-np.clip(slope * (ratio[s] - middle), -700, 700))), abs=1e-6)
            assert got[i].verdict == ("allow" if slope * (ratio[s] - middle) >= 0 else "block")


def test_id_columns_of_any_name_and_repeated_rows(spark):
    rows = [("a", "http://x.net/en/a"), ("a", "http://x.net/en/a"), (None, None), ("b", "http://q.info/zzz"), ("c", "http://w.org/fr/zz"), ("d", "http://w.com/zz")]
    table = spark.createDataFrame(rows, "name string, url string")
    for name in ("name", "host", "ratio", "ruled", "gram", "page_id"):
        found = urls.url_filter(table.withColumnRenamed("name", name), id_col=name)
        assert found.columns[0] == name and len(set(found.columns)) == 7
        assert sorted(str(r[0]) for r in found.collect()) == ["None", "a", "a", "b", "c", "d"]
