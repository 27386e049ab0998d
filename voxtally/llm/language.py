"""Language of a text by Bayesian fusion of independent evidence.

Evidence: the likelihood of the text's byte trigrams under each language, the language its
markup declares, the suffix of its address, and a prior for its host. Everything but the
trigram model is counted over all rows by grouped aggregates: what markup and suffixes say
given the language of the text, and how languages are spread over hosts. Host counts are
smoothed towards their domain's, these towards the corpus's, so a host seen once hardly
speaks and one seen often does. A row's own text is left out of its host's and domain's
counts, so that it is not heard twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import once
from voxtally.session import cut_lineage

TRAIN_PER_LANGUAGE = 400  # labelled texts per language that the trigram model is fitted on
BINS = 1 << 16
TEMPER = 0.1  # neighbouring trigrams overlap and repeat; a text speaks with a tenth of its sum
STRENGTH = 20.0  # rows a parent level counts for
BROADCAST_GROUPS = 10_000  # rows of a host table, about 1 MB


def trigrams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint16)
    mixed = (b[:-2] << np.uint32(16)) ^ (b[1:-1] << np.uint32(8)) ^ b[2:]
    return ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


class Model:
    """Log probabilities of hashed trigrams by language, additively smoothed."""

    def __init__(self, labelled: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in labelled})
        counts = np.full((BINS, max(1, len(self.languages))), 0.5)
        for lang, text in labelled:
            counts[:, self.languages.index(lang)] += np.bincount(
                trigrams(text.lower().encode()), minlength=BINS)
        self.logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def likelihoods(self, text: bytes) -> np.ndarray:
        return self.logs[trigrams(text)].sum(axis=0, dtype=np.float64)[: len(self.languages)]


def fit(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """A model of at most ``per_language`` labelled texts of each language, by id hash.

    Of each language a share of the hash range is drawn first that holds about twice as many
    texts, so that what is ranked does not grow with the table.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(2**32)).alias("__o"))
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    shares = [x for lang, n in counts for x in (F.lit(lang), F.lit(int(min(1.0, 2 * per_language / n) * 2**32)))]
    if not shares:
        return Model([])
    order = Window.partitionBy("lang").orderBy("__o", "text")
    drawn = rows.where(F.col("__o") < F.element_at(F.create_map(*shares), F.col("lang")))
    chosen = drawn.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_language)
    return Model([(r["lang"], r["text"]) for r in chosen.select("lang", "text").collect()])


def visible(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(no_code, "<[^>]*>", " ")


def declared(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(found != "", found)


def _likelihoods(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    fields = [rows.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                model.likelihoods((t.as_py() or b"").lower()).tolist()
                for t in batch.column("text").cast(pa.large_binary())
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(scores, pa.list_(pa.float64()))],
                names=[*keep, "likelihoods"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, likelihoods array<double>")


def _softmax(logs: Column) -> Column:
    """Log scores to probabilities, the largest first subtracted; equal for no evidence."""
    def scaled(x: Column) -> Column:
        return F.transform(x, lambda v: F.exp(v - F.array_max(x)))

    def share(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return F.transform(x, lambda v: v / total)

    one = F.get(F.transform(F.array(logs), scaled), F.lit(0))
    return F.get(F.transform(F.array(one), share), F.lit(0))


def _spread(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """``n`` and, per language, the summed text probabilities of each group."""
    sums = [F.sum(F.get("__p", F.lit(i))) for i in range(k)]
    return rows.groupBy(*by).agg(F.array(*sums).alias("counts"), F.count("*").alias("n"))


def _towards(counts: Column, parent: Column, k: int) -> Column:
    n = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
    return F.array(*[
        (F.get(counts, F.lit(i)) + STRENGTH * F.get(parent, F.lit(i))) / (n + STRENGTH) for i in range(k)
    ])


def _others(counts: Column) -> Column:
    """Summed probabilities of a group without the row at hand."""
    return F.zip_with(counts, "__p", lambda total, own: F.greatest(total - own, F.lit(0.0)))


def _small(df: DataFrame) -> DataFrame:
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def identify(rows: DataFrame, model: Model, ids: list[str]) -> DataFrame:
    """``ids``, ``lang``, ``confidence``, ``text_lang``, ``declared``, ``suffix``, ``host``.

    ``rows``: the id columns, ``text``, ``declared`` (language of the markup or null) and
    ``host`` (null: unknown). The suffix is the host's last label, its domain the last two.
    ``lang`` maximises prior(host) * P(text) ** TEMPER * P(declared) * P(suffix); its
    posterior is ``confidence``. A null or empty text leaves the other evidence; null
    evidence says nothing; ties go to the first language by name. Repeated rows are judged
    alike. With no labelled text at all the language is null. Further columns are left out.
    """
    k = len(model.languages)
    host = F.lower("host")
    labels = F.split(host, r"\.")
    base = rows.select(
        *ids, "text", F.lower("declared").alias("declared"), host.alias("host"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"))
    keep = [*ids, "declared", "host", "suffix", "domain"]
    if not k:
        return base.select(*ids, *[F.lit(None).cast("string").alias(c) for c in ("lang", "text_lang")],
                           F.lit(None).cast("double").alias("confidence"), "declared", "suffix", "host")
    tempered = F.transform("likelihoods", lambda v: v * TEMPER)
    scored = cut_lineage(_likelihoods(base, model, keep).withColumn("__p", _softmax(tempered)))

    everywhere = _spread(scored, [], k).first()
    total = max(everywhere["n"], 1)
    overall = [((c or 0.0) + 1.0) / (total + k) for c in everywhere["counts"]]
    root = F.array(*[F.lit(p) for p in overall])

    domains = _small(_spread(scored.where("domain IS NOT NULL"), ["domain"], k).select(
        F.col("domain").alias("__d"), F.col("counts").alias("__of_domain")))
    hosts = _spread(scored.where("host IS NOT NULL"), ["host", "domain"], k).join(
        domains, F.col("domain") == F.col("__d"))
    hosts = _small(hosts.select(F.col("host").alias("__h"), F.col("counts").alias("__of_host"), "__of_domain"))

    out = scored.join(hosts, F.col("host") == F.col("__h"), "left")
    # What markup and suffixes are seen with each language, against how often at all.
    for name in ("declared", "suffix"):
        seen = _small(_spread(scored.where(F.col(name).isNotNull()), [name], k).select(
            F.col(name).alias(f"__{name}_key"),
            F.array(*[
                F.log((F.get("counts", F.lit(i)) + STRENGTH * overall[i]) / ((F.col("n") + STRENGTH) * overall[i]))
                for i in range(k)
            ]).alias(f"__{name}")))
        out = out.join(seen, F.col(name) == F.col(f"__{name}_key"), "left")

    def part(column: str, i: int) -> Column:
        return F.coalesce(F.get(column, F.lit(i)), F.lit(0.0))

    domain = once(_others(F.col("__of_domain")), lambda counts: _towards(counts, root, k))
    by_host = once(F.struct(_others(F.col("__of_host")).alias("counts"), domain.alias("parent")),
                   lambda x: _towards(x["counts"], x["parent"], k))
    # No host, no counts: the prior of the corpus.
    out = out.withColumn("__prior", F.when(F.col("__h").isNotNull(), by_host).otherwise(root))
    prior = F.col("__prior")
    fused = F.array(*[
        F.log(F.get(prior, F.lit(i))) + part("likelihoods", i) * TEMPER + part("__declared", i) + part("__suffix", i)
        for i in range(k)
    ])
    names = F.array(*[F.lit(name) for name in model.languages])

    def first_of(p: Column) -> Column:
        return F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    out = out.withColumn("__posterior", _softmax(fused))
    return out.select(
        *ids, first_of(F.col("__posterior")).alias("lang"), F.array_max("__posterior").alias("confidence"),
        F.when(F.array_max("likelihoods") < 0, first_of(F.col("__p"))).alias("text_lang"),
        "declared", "suffix", "host")
