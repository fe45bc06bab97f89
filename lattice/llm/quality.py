"""Quality rules per document and per host.

Each document is measured once. The host (the document's source) gets, for each rule, the rate of its documents that
fail; rates are shrunk by a beta prior fitted to all hosts by moments, so a host with few documents stays near the mean
of the corpus. Documents of hosts whose shrunk rate lies far above what the prior lets expect are rejected as well.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import drop_ids, map_docs, raw
from lattice.plans.materialize import heavy_keys, lookup_join, materialize

#: Standard deviations of the prior that a host's rate may lie above the mean; bounds of the limit that follows.
MARGIN, LEAST_LIMIT, MOST_LIMIT = 3.0, 0.2, 0.5
_CONTINUATION = bytes(range(0x80, 0xC0))
_WORDY = bytes(set(range(256)) - set(b"#*$%&|<>"))


def rules() -> dict[str, Column]:
    """The rules whose failures a host answers for."""
    return {
        "short": F.col("n_words") < 50,
        "repetition": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    }


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows, repeated = list(zip(words, words[1:], words[2:], strict=False)), 0
    if len(set(windows)) < len(windows):
        found, end = Counter(windows), 0
        for at, window in enumerate(windows):
            if found[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return len(words), len(b"".join(words).translate(None, _CONTINUATION)), len(text.translate(None, _WORDY)), len(lines), len(lines) - len(set(lines)), repeated


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, the six measures): a row for each row of ``docs``; a null host is the empty host."""
    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    return map_docs(docs, [F.col(id_col).cast("long"), F.coalesce(F.col(host_col).cast("string"), F.lit("")), raw(text_col)], schema, lambda i, h, t: (i, h, *measure(t)))


def host_rates(measured: DataFrame, margin: float = MARGIN, least: float = LEAST_LIMIT, most: float = MOST_LIMIT) -> DataFrame:
    """(host, host_docs, for each rule fails_<rule>, rate_<rule>, prior_<rule>, limit_<rule>, and host_rejected).

    The prior of a rule is a beta distribution with the corpus's failure rate m as mean; its weight k (prior_<rule>) follows from the
    variance of host rates beyond what binomial chance gives, held between 1 and 1e6. The shrunk rate is
    (failures + m k) / (n + k). The limit lies ``margin`` standard deviations of the prior above m, but between ``least`` and
    ``most``; a host is rejected when a shrunk rate is above its limit.
    """
    fails = rules()
    hosts = materialize(measured.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.sum(c.cast("long")).alias(f"fails_{r}") for r, c in fails.items())))
    total = hosts.agg(F.coalesce(F.sum("host_docs"), F.lit(0)).alias("n"), F.count("*").alias("h"), *(F.sum(f"fails_{r}").alias(r) for r in fails)).first()
    mean = {r: total[r] / total["n"] if total["n"] else 0.0 for r in fails}
    n = F.col("host_docs")
    spread = hosts.agg(*(F.sum(n * F.pow(F.col(f"fails_{r}") / n - m, 2)).alias(r) for r, m in mean.items())).first()
    out = [F.col("host"), n]
    over = F.lit(False)
    for r, m in mean.items():
        chance = m * (1 - m)
        between = (spread[r] - chance * total["h"]) / total["n"] if total["n"] else 0.0
        weight = min(max(chance / between - 1, 1.0), 1e6) if between > 0 else 1e6
        limit = min(max(m + margin * math.sqrt(chance / (weight + 1)), least), most)
        rate = (F.col(f"fails_{r}") + m * weight) / (n + weight)
        over = over | (rate > limit)
        out += [F.col(f"fails_{r}"), rate.alias(f"rate_{r}"), F.lit(weight).alias(f"prior_{r}"), F.lit(limit).alias(f"limit_{r}")]
    return hosts.select(*out, over.alias("host_rejected"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", margin: float = MARGIN, least: float = LEAST_LIMIT, most: float = MOST_LIMIT) -> DataFrame:
    """(doc_id, host, the measures, base_failed, kept, and the columns of :func:`host_rates`): a row for each row of ``docs``.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. host_rejected: a shrunk rate of the
    host is over its limit. Null, empty and blank texts measure zero and fail; very long ones are measured whole. Null hosts form one
    host. Repeated rows count each time. Other columns are ignored; an empty table gives no rows.
    """
    fails = rules()
    measured = materialize(measures(docs, id_col, text_col, host_col))
    rates = materialize(host_rates(measured, margin, least, most))
    out = lookup_join(measured, rates, "host", heavy_keys(rates, "host", "host_docs"))
    failed = fails["short"] | fails["repetition"]
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", margin: float = MARGIN, least: float = LEAST_LIMIT, most: float = MOST_LIMIT) -> DataFrame:
    """``docs`` without the rejected documents, all columns kept; rows with a null id can't be named and stay.

    Of rows that repeat an id, all go if any is rejected.
    """
    found = quality(docs, id_col, text_col, host_col, margin, least, most)
    bad = materialize(found.filter(~F.col("kept")).select(F.col("doc_id").alias(id_col)))
    return drop_ids(docs, bad, id_col)
