"""Quality rules whose failures are judged by host."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import apart, checkpointed, map_texts, table, with_numbers

#: Hosts up to which their few numbers are broadcast, and words from which a text's windows are numbered by parts.
BROADCAST_HOSTS, LONG_TEXT = 100_000, 20_000

_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words that lie in a 5-word window found twice or more in `words`."""
    if len(words) < 6:
        return 0
    if len(words) <= LONG_TEXT:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        number: dict = {}
        ids = np.array([number.setdefault(w, len(number)) for w in windows])
    else:
        # Windows of a long text are numbered by numbers of their parts, without a tuple for each.
        names: dict = {}
        one = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
        both = lambda a, b: np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]
        two = both(one[:-1], one[1:])
        ids = both(both(two[:-2], two[2:])[:-1], one[4:])
    hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_rules(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""

    def count(texts: list[str]):
        rows = []
        for text in texts:
            raw = text.encode()
            words = raw.split()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            rows.append((len(words), len(text) - len(raw) + len(raw.translate(None, _SPACE)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)))
        return list(np.array(rows, np.int64).reshape(-1, 5).T)

    return map_texts(docs, keep, text_col, count, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint")


#: The rules, each of which has a rate of failures for each host. A text fails "short" with fewer than 10 words, "repeats"
#: with more than 20 of 100 words in repeated 5-word windows, "symbols" if they are over a tenth of its word
#: characters, "lines" with a duplicate line for fewer than 30 words.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "30 * n_dup_lines > n_words",
}


def host_verdicts(failures: DataFrame, host: str, rules: list[str], threshold: float = 0.5) -> DataFrame:
    """For each non-null host: n_docs, the shrunk rate of each rule (rate_...), and host_rejected.

    `failures` has a boolean column for each rule.  A rule's prior is a beta distribution fitted by moments to
    the hosts' rates: its mean m is the overall rate and its strength s comes from how much the hosts' rates
    vary beyond chance.  A host's shrunk rate is (failures + m s) / (n_docs + s); the host is rejected if that of
    any rule exceeds `threshold`.
    """
    hosts = checkpointed(failures.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), *(F.sum(F.col(r).cast("bigint")).alias(f"k_{r}") for r in rules)))
    n, hosts_n, n2, *k = hosts.agg(F.sum("n_docs"), F.count("*"), F.sum(F.col("n_docs").cast("double") ** 2), *(F.sum(f"k_{r}") for r in rules)).first()
    means = [x / n if n else 0.0 for x in k]
    spreads = hosts.agg(*(F.sum(F.col("n_docs") * (F.col(f"k_{r}") / F.col("n_docs") - m) ** 2) for r, m in zip(rules, means, strict=True))).first()
    rates = []
    for r, mean, spread in zip(rules, means, spreads, strict=True):
        noise, strength = mean * (1 - mean), 1.0
        if n:
            # The spread expected of equal hosts is m(1-m)(hosts-1); what is above it is the variance between hosts.
            between = (spread - noise * (hosts_n - 1)) / (n - n2 / n) if n > n2 / n else 0.0
            strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6 if noise else 1.0
        rates.append(((F.col(f"k_{r}") + mean * strength) / (F.col("n_docs") + strength)).alias(f"rate_{r}"))
    most = F.greatest(*(f"rate_{r}" for r in rules)) if len(rules) > 1 else F.col(f"rate_{rules[0]}")
    return hosts.select(host, "n_docs", *rates).withColumn("host_rejected", most > threshold)


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """`id_col`, the counts of `text_rules`, base_failed, the rates of RULES, host_rejected and kept, for every row.

    base_failed: the text is short or repeats itself.  Each rule's failures are counted by host and shrunk
    (`host_verdicts`).  kept: not base_failed and the host is not rejected; a rate of exactly `threshold` does
    not reject.  A null host has no rates and no verdict.  Null and empty texts have no words and fail; very long texts
    are read whole; an empty table gives an empty result; other columns may have any names.
    """
    rows, back = apart(docs.select(id_col, text_col, host_col))
    rows = rows.select(F.col(back[id_col]).alias("id"), F.col(back[host_col]).cast("string").alias("host"), F.col(back[text_col]).alias("text"))
    facts = text_rules(rows, ["id", "host"])
    facts = checkpointed(facts.withColumns({r: F.expr(x) for r, x in RULES.items()}))
    hosts = host_verdicts(facts, "host", list(RULES), threshold).drop("n_docs")
    judged = with_numbers(facts, hosts, "host", F.xxhash64("id", "n_words", "word_chars"), BROADCAST_HOSTS, how="left")
    base = F.col("short") | F.col("repeats")
    judged = judged.withColumns({"base_failed": base, "kept": ~base & ~F.coalesce(F.col("host_rejected"), F.lit(False))})
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("id").alias(id_col), *counts, "base_failed", "kept", *(f"rate_{r}" for r in RULES), "host_rejected")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rules(table(spark, sf_dir, "documents"))
    return rows.withColumns({f"rate_{r}": F.round(f"rate_{r}", 6) for r in RULES})
