"""URL filter: host/path rules first, then a character language-model ratio.

Two variable-order Markov models of characters (orders 0 to ``ORDER``, interpolated with Witten-Bell
weights) are counted from all URLs that a rule accepts or rejects. An undecided URL is judged by the
difference of its log-likelihoods under both models, per character. The difference is calibrated on rule-decided
URLs held out of the counts: with the means and the pooled variance of both classes it becomes log-odds,
and the verdict is their sign.

Everything is DataFrame work: URLs are exploded to (context, character) grams and counted with map-side
partial aggregation; only distinct grams meet the count tables; two means and variances reach the driver.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by
the model as an empty string; URLs of any length are judged whole; without accepted or without rejected URLs the model allows; even odds allow; rows that repeat are
judged each by itself, and in the counts each; ids may be of any type and null; an empty table gives an empty table; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free
from .storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of context of the longest Markov order.
ORDER = 4
#: Size of the uniform distribution below order 0.
ALPHABET = 256
#: One in so many rule-decided URLs is held out for the calibration.
HOLD_OUT = 5


@dataclass(frozen=True)
class HostRule:
    """``text`` is host and path prefix, such as ``example.net/en/``; ``verdict`` is allow or block."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


RULES = (HostRule("net/", "block"), HostRule("example.net/en/", "allow"), HostRule("example.com/de/", "block"), HostRule("org/fr/", "allow"))


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: HostRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: tuple[HostRule, ...], host: Column, path: Column) -> Column:
    """The text of the longest rule that fits, else null."""
    found = [F.when(fits(r, host, path), F.lit(r.text)) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def split_urls(pages: DataFrame, rules: tuple[HostRule, ...], id_col: str, url_col: str) -> DataFrame:
    """(row_id, host, path, rule, ruled): ruled is the verdict of the rule, null without one."""
    parts = pages.select(F.col(id_col).alias("row_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parts = parts.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce(*[F.when(F.col("rule") == r.text, F.lit(r.verdict)) for r in rules]) if rules else F.lit(None).cast("string")
    return parts.withColumn("ruled", verdict)


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row per character of ``host || path`` and of its end mark: ``gram`` holds ORDER characters of context, then the character."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("host"), F.col("path"), F.lit("\x03"))
    places = F.sequence(F.lit(1), F.length("padded") - ORDER)
    return urls.select(*keep, padded.alias("padded")).select(*keep, F.explode(F.transform(places, lambda i: F.substring(F.col("padded"), i, F.lit(ORDER + 1)))).alias("gram"))


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, a, r): how often each full gram stands in accepted and in rejected URLs."""
    one = lambda verdict: F.sum(F.when(F.col("ruled") == verdict, 1).otherwise(0))
    return grams(urls, "ruled").groupBy("gram").agg(one("allow").alias("a"), one("block").alias("r"))


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, llr) for each gram of ``wanted``: log P(char | context) of the accepted less the rejected model.

    ``counts`` has the longest grams; a shorter gram's count is the sum over the grams that end in it. A gram
    of ``wanted`` meets its suffixes and their contexts in one join each, then a fold over the orders.
    """
    orders = F.sequence(F.lit(0), F.lit(ORDER))
    suffix = lambda gram, k: F.substring(gram, ORDER + 1 - k, k + 1)
    shorter = counts.select(F.explode(F.transform(orders, lambda k: suffix(F.col("gram"), k))).alias("g"), "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    context = F.expr("substring(g, 1, length(g) - 1)")
    seen = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    contexts = shorter.groupBy(context.alias("context")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), seen("a").alias("ta"), seen("r").alias("tr"))
    asked = wanted.select("gram", F.posexplode(F.transform(orders, lambda k: suffix(F.col("gram"), k))).alias("k", "g")).withColumn("context", context)
    # every gram asks for the empty context, which would be one key of a fifth of the rows: its four numbers go into the plan
    whole = contexts.filter("context = ''").first()
    found = asked.filter("k > 0").join(contexts.filter("context <> ''"), "context", "left").unionByName(
        asked.filter("k = 0").select("*", *[F.lit(whole[c] if whole else None).cast("long").alias(c) for c in ("na", "nr", "ta", "tr")])
    ).join(shorter, "g", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    by_order = found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", *[zero(c) for c in ("a", "r", "na", "nr", "ta", "tr")]))).alias("orders"))

    def smoothed(n: str, total: str, types: str) -> Column:
        step = lambda p, x: F.when(x[total] > 0, (x[n] + x[types] * p) / (x[total] + x[types])).otherwise(p)
        return F.aggregate("orders", F.lit(1.0 / ALPHABET), step)

    return by_order.select("gram", (F.log(smoothed("a", "na", "ta")) - F.log(smoothed("r", "nr", "tr"))).alias("llr"))


def scored(urls: DataFrame, ratios: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``ratio``, the mean log-likelihood difference per character. ``keep`` identifies a row."""
    return grams(urls, *keep).join(ratios, "gram", "left").groupBy(*keep).agg(F.avg(F.coalesce("llr", F.lit(0.0))).alias("ratio"))


def calibration(held_out: DataFrame) -> tuple[float, float]:
    """(slope, middle) such that slope * (ratio - middle) are log-odds of acceptance, from a few sums."""
    by = {r["ruled"]: r for r in held_out.groupBy("ruled").agg(F.count("ratio").alias("n"), F.avg("ratio").alias("m"), F.var_pop("ratio").alias("v")).collect()}
    a, r = by.get("allow"), by.get("block")
    if not a or not r or a["m"] <= r["m"]:
        return 1.0, 0.0
    pooled = (a["n"] * a["v"] + r["n"] * r["v"]) / (a["n"] + r["n"])
    slope = (a["m"] - r["m"]) / max(pooled, 1e-6)
    return (slope, (a["m"] + r["m"]) / 2) if math.isfinite(slope) else (1.0, 0.0)


def url_filter(pages: DataFrame, rules: tuple[HostRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, ratio and probability (both null where a rule decides); beside an id column of such a name with an underscore behind it."""
    named_out = lambda df: df.select(F.col("row_id").alias(id_col), *[F.col(c).alias(free(c, id_col)) for c in df.columns[1:]])
    urls = split_urls(pages, rules, id_col, url_col)
    named = urls.withColumn("name", F.xxhash64("host", "path"))
    decided, open_ = named.filter("ruled IS NOT NULL"), named.filter("ruled IS NULL")
    held = F.pmod("name", F.lit(HOLD_OUT)) == 0
    to_score = decided.filter(held).unionByName(open_)
    counts = stored(gram_counts(decided.filter(~held)), "url-counts")
    both = counts.agg(F.sum("a"), F.sum("r")).first()
    if not (both[0] and both[1]):
        verdict = F.coalesce("ruled", F.lit("allow"))
        none = F.lit(None).cast("double")
        return named_out(urls.select("row_id", "host", "path", "rule", verdict.alias("verdict"), none.alias("ratio"), none.alias("probability")))
    ratios = stored(log_ratios(counts, grams(to_score).distinct()), "url-ratios")
    slope, middle = calibration(scored(decided.filter(held), ratios, "name", "ruled"))
    keep = ["row_id", "host", "path", "rule"]
    probability = 1 / (1 + F.exp(-slope * (F.col("ratio") - middle)))
    # equal strings have equal scores, so each distinct string is scored once
    scores = scored(open_.select("name", "host", "path").distinct(), ratios, "name", "host", "path")
    judged = open_.join(scores, ["name", "host", "path"], "left").withColumn("probability", probability)
    by_model = judged.select(*keep, F.when(F.col("probability") >= 0.5, "allow").otherwise("block").alias("verdict"), "ratio", "probability")
    none = F.lit(None).cast("double")
    by_rule = decided.select(*keep, F.col("ruled").alias("verdict"), none.alias("ratio"), none.alias("probability"))
    return named_out(by_rule.unionByName(by_model))
