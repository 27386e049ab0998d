"""Quality rules on documents, and a verdict on each host from its documents' failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import SPACES, once, text_of, words
from voxtally.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 20
HOST_LIMIT = 0.5
BROADCAST_HOSTS = 10_000  # rows of the verdict table, about 1 MB


def repeat_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur twice or more, first included.

    Windows are sorted by hash with their position, so a repeat is a neighbour; the positions
    found are then merged. Linear steps and one sort per text, whatever repeats.
    """
    def covered(found: Column) -> Column:
        at = F.sort_array(F.transform(
            F.filter(
                found,
                lambda x, j: (F.get(found, j - 1)["h"] == x["h"]).eqNullSafe(True)
                | (F.get(found, j + 1)["h"] == x["h"]).eqNullSafe(True),
            ),
            lambda x: x["i"],
        ))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            at, start,
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def ordered(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of_hashes(hashes: Column) -> Column:
        # Without a repeated window there is nothing to sort.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            once(ordered(hashes), covered)
        )

    return F.when(F.size(tokens) < 3, F.lit(0)).otherwise(once(windows(tokens), of_hashes))


def rule_stats(documents: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``
    and ``base_failed``, ``failed``. A null text counts as empty."""
    text = text_of(F.col("text"))
    dup_lines = once(
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.size(x) - F.size(F.array_distinct(x)),
    )
    tokens = once(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("repeat")))
    out = documents.withColumns({
        "__words": tokens,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": dup_lines.cast("long"),
    }).withColumns({
        "n_words": F.col("__words.n"), "n_repeat_words": F.col("__words.repeat"),
    }).drop("__words")
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    chars = F.col("word_chars")
    more = (
        (100 * F.col("n_symbols") > SYMBOL_PERCENT * chars)
        | (chars < MIN_WORD_CHARS * n) | (chars > MAX_WORD_CHARS * n)
        | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.size(F.split(text, "\n", -1)))
    )
    return out.withColumns({"base_failed": base}).withColumns({"failed": F.col("base_failed") | more})


def host_verdicts(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per ``source``: ``n_docs``, ``n_failed``, ``host_rate``, ``host_kept``.

    Failure rates are shrunk towards the corpus by a beta prior whose mean and strength are
    the moments of the hosts' own rates: prior variance is what the spread between hosts
    exceeds sampling by, and its strength is held between 2 and 10,000 documents. A host is
    kept while its shrunk rate is at most ``limit``. A null source is a host of its own.
    """
    hosts = cut_lineage(stats.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    n, failed, count = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count("*")).first()
    mean = failed / n if n else 0.0
    spread = hosts.agg(F.sum(
        F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - mean, 2))).first()[0]
    noise = mean * (1 - mean)
    between = (spread / n - noise * count / n) if n else 0.0
    strength = min(max(noise / between - 1, 2.0), 1e4) if between > 0 else 1e4
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumns({"host_rate": rate, "host_kept": rate <= limit})


def judge(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The frame of ``rule_stats``, staged by the caller, with ``host_rate`` and ``kept``.

    ``kept``: no base rule fails and the host is kept. Other rules count towards the host
    only. Hosts are one row each: broadcast when counted to at most ``BROADCAST_HOSTS``,
    otherwise joined by sorting, where adaptive execution splits a host with many rows.
    Repeated rows count each; an empty table gives an empty one.
    """
    hosts = cut_lineage(host_verdicts(stats, limit).select(
        F.col("source").alias("__source"), F.col("host_rate").alias("__rate"),
        F.col("host_kept").alias("__kept")))
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    return stats.join(side, F.col("source").eqNullSafe(F.col("__source"))).withColumns({
        "host_rate": F.col("__rate"), "kept": ~F.col("base_failed") & F.col("__kept"),
    }).drop("__source", "__rate", "__kept")
