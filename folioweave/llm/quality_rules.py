"""Quality rules with host verdicts.

Each text gets a few counts, the counts fail or pass rules, the failures are summed by host, each host's
failure rate is shrunk towards an empirical beta prior, and the host's verdict comes back to its documents:
a document of a suspect host is held to the strict rules, one of any other host to the lenient rules.

Defined cases: a null text has no words (it fails the base rules); a null host is a host of its own; repeated
rows are judged and counted one by one; an empty table gives an empty result; other columns pass untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.session import fresh, materialize

WORD_BREAKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Up to so many suspect hosts (names of domains) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FACTS_DDL = ", ".join(f"{x} long" for x in FACTS)


@dataclass(frozen=True)
class Rules:
    """Limits. ``strict`` rules hold for suspect hosts, ``lenient`` ones for all."""

    min_words: int = 50
    max_repeat_pct: int = 50
    lenient_symbols_pct: int = 25
    strict_symbols_pct: int = 10
    lenient_dup_lines_pct: int = 70
    strict_dup_lines_pct: int = 30
    strict_repeat_pct: int = 20
    suspect_rate: float = 0.5
    prior_strength: tuple[float, float] = field(default=(2.0, 1e6))


def text_facts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one whole text, in the order of ``FACTS``."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WORD_BREAKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WORD_BREAKS)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _facts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_facts(x) for x in batch], columns=list(FACTS))


def rule_failures(f: Column, r: Rules) -> dict[str, Column]:
    """Boolean columns of one document: what it fails at, by rule."""
    words, repeats = f["n_words"], f["n_repeat_words"]
    return {
        "base": (words < r.min_words) | (100 * repeats > r.max_repeat_pct * words),
        "lenient": (100 * f["n_symbols"] > r.lenient_symbols_pct * words) | (100 * f["n_dup_lines"] > r.lenient_dup_lines_pct * f["n_lines"]),
        "symbols": 100 * f["n_symbols"] > r.strict_symbols_pct * words,
        "lines": 100 * f["n_dup_lines"] > r.strict_dup_lines_pct * f["n_lines"],
        "repeats": 100 * repeats > r.strict_repeat_pct * words,
    }


STRICT = ("symbols", "lines", "repeats")


def prior(hosts: int, docs: int, squares: float, failed: int, failed_squares: float, low: float, high: float) -> tuple[float, float]:
    """Mean and strength of a rule's prior, by the sums over hosts of n, n * n, k and k * k / n (k of n documents fail)."""
    mean = failed / docs if docs else 0.0
    if hosts < 2 or docs == hosts:
        return mean, high
    between = (failed_squares - mean * failed) / (hosts - 1)
    within = (failed - failed_squares) / (docs - hosts)
    size = (docs - squares / docs) / (hosts - 1)
    if between <= within:
        return mean, high
    # 1 / rho - 1, which is size * within / (between - within)
    return mean, min(high, max(low, size * within / (between - within)))


def host_table(failures: DataFrame, host: str, rules: Rules) -> DataFrame:
    """One row per host: documents, failures and shrunk failure rate by strict rule, and ``suspect``. Sums by host are written.

    The prior of a rule is the beta distribution with the mean of all documents and the strength 1 / rho - 1, rho being the
    correlation of documents of one host by the analysis of variance: what hosts differ beyond chance, whatever their
    numbers of documents. Without two hosts, a host of two documents, or such a difference, it has the largest strength. Only
    that one row of sums reaches the driver.
    """
    hosts = failures.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *(F.sum(F.col(x).cast("long")).alias(f"host_{x}") for x in STRICT))
    hosts = materialize(hosts, "hosts")
    n = F.col("host_docs")
    sums = hosts.agg(F.count(n).alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n.cast("double")).alias("squares"), *(y for x in STRICT for y in (F.sum(f"host_{x}").alias(x), F.sum(F.col(f"host_{x}") * (F.col(f"host_{x}") / n)).alias(f"{x}_squares")))).first()
    low, high = rules.prior_strength
    for x in STRICT:
        mean, strength = prior(sums["hosts"], sums["docs"] or 0, sums["squares"] or 0.0, sums[x] or 0, sums[f"{x}_squares"] or 0.0, low, high)
        hosts = hosts.withColumn(f"{x}_rate", (F.col(f"host_{x}") + F.lit(mean * strength)) / (n + F.lit(strength)))
    suspect = F.greatest(*(F.col(f"{x}_rate") for x in STRICT)) > rules.suspect_rate
    return hosts.withColumn("suspect", suspect)


def with_facts(docs: DataFrame, text: str = "text", facts: str = "facts") -> DataFrame:
    """``docs`` with a struct of the counts of each whole text. ``facts`` must be a free name.

    The function is declared nondeterministic, which it is not, so that filters on counts are not pushed below it and
    each text is counted once.
    """
    return docs.withColumn(facts, F.pandas_udf(_facts, FACTS_DDL).asNondeterministic()(F.col(f"`{text}`")))


def verdicts(counted: DataFrame, host: str = "source", facts: str = "facts", rules: Rules | None = None, written: bool = True) -> DataFrame:
    """``counted`` (rows with the counts) with ``kept``; ``base_failed`` and ``suspect_host`` join the counts.

    The hosts' sums must be complete before the first verdict, so the rows are written once; without ``written`` they are
    counted again instead, which is less where they carry their texts. Sums by host combine before the shuffle; the suspect hosts come back by a broadcast while their count is within a checked bound,
    else by an equi-join whose large side Spark can split.
    """
    rules = rules or Rules()
    kept, key = fresh(counted, "kept"), fresh(counted, "host_key")
    names = counted.columns
    counted = counted.withColumn(key, F.col(f"`{host}`").cast("string"))
    counted = materialize(counted, "quality-facts") if written else counted
    fails = rule_failures(F.col(facts), rules)
    hosts = host_table(counted.select(key, *(fails[x].alias(x) for x in STRICT)), key, rules)
    suspects = hosts.where("suspect").select(F.col(key).alias("_suspect_key"), F.lit(True).alias("_suspect"))
    few = suspects.count() <= MOST_BROADCAST
    joined = counted.join(F.broadcast(suspects) if few else suspects, F.col(key).eqNullSafe(F.col("_suspect_key")), "left")
    flag = F.coalesce(F.col("_suspect"), F.lit(False))
    strict = fails["symbols"] | fails["lines"] | fails["repeats"]
    return joined.select(
        *(F.col(f"`{c}`") for c in names if c != facts),
        F.struct(*(F.col(facts)[x].alias(x) for x in FACTS), fails["base"].alias("base_failed"), flag.alias("suspect_host")).alias(facts),
        (~fails["base"] & ~fails["lenient"] & ~(flag & strict)).alias(kept),
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules | None = None) -> DataFrame:
    """``docs`` with two more last columns: the counts (struct ``facts``) and ``kept``.

    Where ``docs`` has these names, underscores are appended to the new ones.
    """
    facts = fresh(docs, "facts")
    return verdicts(with_facts(docs, text, facts), host, facts, rules, written=False)
