"""Quality rules per document, and verdicts per host. DataFrame functions only.

A document is measured by native expressions over its whole text. Every rule's failures are
counted per host, the failing rates are shrunk with a beta prior fitted to all hosts (an empirical
Bayes estimate: hosts with few documents move towards the corpus mean), and a host whose shrunk
rate passes the rule's limit loses all its documents.

Defined cases: a null text has no words; very long texts are measured whole; hosts with equal rates fare alike; an empty host table has no prior and rejects nobody; a null
host is a host of its own; repeated rows are measured and counted one by one; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, small_side, text_or_empty, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"
#: A host is rejected for a rule if its shrunk failing rate is above this share of documents: when more of
#: them fail than not, by what the corpus lets expect of a host of its size.
HOST_LIMITS = {"base": 0.5, "symbols": 0.5, "dup_lines": 0.5, "word_length": 0.5}


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(w: Column) -> Column:
    """array<long>, one 64-bit hash for each window of three words."""
    return F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more in the array.

    Windows sorted by hash, those equal to a neighbour kept and sorted by place: each adds the
    words that the window before it does not cover yet, three at most.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    once = F.size(F.array_distinct(hashes)) == F.size(hashes)
    # let: one-element transform, so that the sorted array is made once and read by place
    found = F.get(F.transform(F.array(pairs), lambda s: covered(F.sort_array(repeated(s)))), 0)
    return F.when(once, F.lit(0).cast("long")).otherwise(found)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host, the five measures and a flag for each rule that a document fails."""
    text = text_or_empty()
    split = docs.select("doc_id", F.col("source").alias("host"), text.alias("text")).withColumn("w", words(F.col("text")))
    hashed = split.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        window_hashes(F.col("w")).alias("g"),
    )
    return hashed.withColumn("n_repeat_words", repeat_words(F.col("g"))).drop("g")


def rules() -> dict[str, Column]:
    """Failures; base is the one that rejects a document by itself."""
    n = F.col("n_words")
    return {
        "base": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def shrunk(hosts: DataFrame, names: list[str]) -> DataFrame:
    """hosts (host, n, one failure count per rule) with rate_<rule>: (k + a) / (n + a + b), a and b
    by the method of moments over the hosts' raw rates; without spread the mean itself."""
    total = F.sum("n")
    moments = []
    for r in names:
        rate = F.col(r) / F.col("n")
        moments += [(F.sum(r) / total).alias(f"m_{r}"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias(f"v_{r}")]
    prior = hosts.agg(*moments)
    out = hosts.crossJoin(F.broadcast(prior))  # one row of moments
    for r in names:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0)))
        out = out.withColumn(
            f"rate_{r}",
            F.when(strength.isNull(), m).otherwise((F.col(r) + m * strength) / (F.col("n") + strength)),
        )
    return out.drop(*[f"{x}_{r}" for r in names for x in "mv"])


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failures and shrunk rates for each rule, and host_rejected."""
    checks = rules()
    counts = [F.count_if(c).alias(r) for r, c in checks.items()]
    hosts = shrunk(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *counts), list(checks))
    above = [F.col(f"rate_{r}") > limit for r, limit in HOST_LIMITS.items()]
    rejected = above[0]
    for x in above[1:]:
        rejected = rejected | x
    return hosts.withColumn("host_rejected", rejected)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, host, the measures, base_failed, host_rejected and kept of every document."""
    measured = cut(measure(docs), "measures")
    bad = cut(host_rates(measured).where("host_rejected").select(F.col("host").alias("__bad")), "rejected-hosts")
    joined = measured.join(small_side(bad, 64), F.col("host").eqNullSafe(F.col("__bad")), "left_semi").select("*", F.lit(True).alias("host_rejected"))
    rest = measured.join(small_side(bad, 64), F.col("host").eqNullSafe(F.col("__bad")), "left_anti").select("*", F.lit(False).alias("host_rejected"))
    failed = rules()["base"]
    return joined.unionByName(rest).withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("host_rejected"))
