"""Quality rules: base rules per document, then verdicts per host.

Base rules look at one document: too few words, or too many words inside repeated three-word windows.
Host rules look at all documents of a host (the column `source`): the number that failed the base rules is
aggregated by host, the failure rate is shrunk towards the corpus by a beta prior fitted to all hosts
(moments), and a host whose shrunk rate exceeds MAX_HOST_RATE is rejected with all its documents.

Everything is DataFrame functions. The per-document figures are computed once and written to the shared
folder (a few numbers a row), from where the host totals and the final join read them. Host totals combine
before the shuffle, so a hot host costs no more than any other; the verdicts are broadcast up to
BROADCAST_ROWS rejected hosts and joined by shuffle beyond that, where the adaptive join splits a hot host.

Defined cases: null and empty texts have no words and fail. A null host is a host of its own. Repeated
rows count as documents each and keep their places. An empty table gives an empty result. Columns of the
input that clash with the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, materialise, small, words

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # percent of the words
MAX_HOST_RATE = 0.5
#: Limits of the prior's weight in documents, for hosts that agree entirely or not at all.
PRIOR_WEIGHT = (1.0, 10_000.0)
SYMBOLS = "[#*$%&|<>]"
NO_SYMBOLS = "[^#*$%&|<>]+"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more."""

    def covered(starts: Column) -> Column:
        # Each window covers three words from its start, less where the next one begins sooner.
        gaps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["p"])), covered)

    def of(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, repeated)).otherwise(F.lit(0).cast("long"))

    windows = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows(w), of))


def _figures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))

    def of(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(joined, NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    return let(words(text), of)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the figures and base_failed; no row moves."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    (told,) = fresh(docs, "figures")
    few = F.col(told)["n_words"] < MIN_WORDS
    repetitive = 100 * F.col(told)["n_repeat_words"] > MAX_REPEAT_SHARE * F.col(told)["n_words"]
    return docs.select(*kept, _figures(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(told)).select(*kept, f"{told}.*", (few | repetitive).alias("base_failed"))


def beta_prior(hosts: int, mean: float | None, variance: float | None) -> tuple[float, float]:
    """alpha and beta by moments of the hosts' failure rates."""
    low, high = PRIOR_WEIGHT
    m = min(max(mean if mean is not None else 0.5, 1e-6), 1 - 1e-6)
    spread = variance if hosts > 1 and variance is not None and not math.isnan(variance) else 0.0
    weight = m * (1 - m) / spread - 1 if spread > 0 else high
    weight = min(max(weight, low), high)
    return m * weight, (1 - m) * weight


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk): one row per host."""
    totals = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    a = totals.agg(F.count(F.lit(1)).alias("n"), F.avg(share).alias("m"), F.var_samp(share).alias("v")).first()
    alpha, beta = beta_prior(a["n"], a["m"], a["v"])
    return totals.withColumn("rate", (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta))


def judge_quality(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Figures, base_failed and kept for each row, with the columns of keep (all but the text by default)."""
    carried = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c.lower() not in [*ADDED, "kept"]]
    carry = [F.col(f"`{c}`") for c in carried]
    own_host, own_text, bad, flag = fresh(docs, "host", "text", "bad", "flag")
    own = docs.select(*carry, F.col(f"`{host}`").alias(own_host), F.col(f"`{text}`").alias(own_text))
    judged = materialise(base_rules(own, own_text).drop(own_text), "quality")
    rejected = host_rates(judged, own_host).filter(F.col("rate") > MAX_HOST_RATE).select(F.col("host").alias(bad), F.lit(True).alias(flag))
    joined = judged.join(small(rejected), F.col(own_host).eqNullSafe(F.col(bad)), "left")
    return joined.select(*carry, *ADDED, (~F.col("base_failed") & F.col(flag).isNull()).alias("kept"))
