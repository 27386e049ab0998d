"""Secrets in texts: strong patterns, and parts of credentials that count only together.

Strong patterns report wherever they match. A credential is often spread over several
settings, each too common to report by itself: who asks (identifier), with what (secret), and
where (endpoint). Such weak parts are collected, laid into the scope that holds them (a block
between blank lines) by an interval join, and joined with parts of other roles that start
within ``reach`` code points in the same scope. A weak identifier is reported next to a
secret, a weak secret next to an identifier or an endpoint; strong spans are parts too.

Joins are over cells of the text. Per scope, cell and role two numbers suffice, the first and
the last start: parts of one cell are always within reach, of the cell before the last start
is the nearest, of the cell after the first one. So no two parts are ever paired one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import once, row_key, text_of
from voxtally.session import cut_lineage


def either_case(text: str) -> str:
    """A pattern in which every letter may be upper or lower case."""
    out, plain = [], True
    for c in text:
        out.append(f"[{c.upper()}{c}]" if c.islower() and plain else c)
        plain = c != "\\"
    return "".join(out)


def setting(names: str, value: str) -> str:
    return f"(?:{either_case(names)})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


KINDS = ("assign", "access", "hex")
# Strong: kind, pattern, group that is measured, least length.
STRONG = (
    ("assign", setting("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
# Weak: role, kind it is reported as (an endpoint is not), pattern.
WEAK = (
    ("identifier", "access", "(?:ASIA|AIDA|AROA)[A-Z0-9]{16,}"),
    ("identifier", "access", setting("client_?id|access_?id|account|login|username|user", "[A-Za-z0-9+/_.@=-]{3,}")),
    ("secret", "assign", setting("passphrase|pass|pwd|private_?key|signature|credential|auth", "[A-Za-z0-9+/_.=-]{6,}")),
    ("secret", "hex", "[0-9A-F]{24,}"),
    ("endpoint", "", "(?:https?|wss?|redis|amqp|mongodb|postgres|mysql|s3)://[^\\x20\\x09-\\x0D\"'<>]{4,}"),
    ("endpoint", "", setting("host|endpoint|server|base_?url", "[A-Za-z0-9._:/-]{4,}")),
)
BREAK = "\\n[\\x20\\x09\\x0D]*\\n"
REACH = 300
#: Widths of the cells for overlaps and scopes.
NARROW, WIDE = 64, 1024
KEY = ["__k0", "__k1", "__k2"]


def running(lengths: Column) -> Column:
    """Running totals of an array. Blocks of the root of its size keep the work of very long
    arrays far below the square of their length."""

    def total(values: Column, begin: Column, count: Column) -> Column:
        return F.aggregate(F.slice(values, begin + 1, count), F.lit(0).cast("long"), lambda s, x: s + x)

    def by_block(a: Column, size: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda j: total(a, j * size, size))
        return once(blocks, lambda b: once(
            F.transform(b, lambda _, j: total(b, F.lit(0), j)),
            lambda before: F.transform(
                a, lambda _, i: F.get(before, F.floor(i / size).cast("int")) + total(
                    a, F.floor(i / size).cast("int") * size, F.pmod(i, size) + 1))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(
        once(lengths, lambda a: once(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda size: by_block(a, size))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches from the left without overlap, as structs of start, end (code points) and
    the length of a group."""
    piece = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    hit = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.length(h).cast("long"))
    measured = hit if group == 0 else F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda h: F.length(h).cast("long"))

    def placed(h: Column, p: Column) -> Column:
        ends = running(F.zip_with(h, F.slice(p, 1, F.size(h)), lambda x, y: x + y))
        return F.zip_with(F.arrays_zip(ends.alias("e"), h.alias("h")), measured, lambda z, m: F.struct(
            (z["e"] - z["h"]).alias("start"), z["e"].alias("end"), m.alias("size")))

    found = once(hit, lambda h: once(piece, lambda p: placed(h, p)))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,size:bigint>>")
    return F.when(text.rlike(pattern), found).otherwise(nothing)


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _role(kind: Column) -> Column:
    """The part that a strong span plays."""
    return F.when(kind == "access", "identifier").otherwise("secret")


def strong_spans(text: Column) -> Column:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(STRONG):
        good = F.filter(matches(text, pattern, group), lambda m: m["size"] >= least)
        parts.append(F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))))
    return F.array_sort(F.concat(*[p.cast(SPAN) for p in parts]))


def weak_parts(text: Column) -> Column:
    return F.concat(*[
        F.transform(matches(text, pattern), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(role).alias("role"), F.lit(kind).alias("kind")))
        for role, kind, pattern in WEAK])


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cells(start: Column, end: Column, width: int) -> Column:
    """Numbers of the cells that an interval touches; one for an empty interval."""
    last = F.greatest(start, end - 1)
    return F.sequence(F.floor(start / width).cast("long"), F.floor(last / width).cast("long"))


def in_scopes(parts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Interval join: each part with ``scope``, the start of the scope that holds its start."""
    at = parts.withColumn("cell", F.floor(F.col("start") / WIDE).cast("long"))
    over = scopes.select(
        *KEY, F.col("start").alias("scope"), F.col("end").alias("__end"),
        F.explode(_cells(F.col("start"), F.col("end"), WIDE)).alias("cell"))
    return at.join(over, [*KEY, "cell"]).where(
        (F.col("start") >= F.col("scope")) & (F.col("start") < F.col("__end"))).drop("cell", "__end")


def clear_of(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """Interval anti-join: the parts that no span overlaps."""
    spread = parts.withColumn("cell", F.explode(_cells(F.col("start"), F.col("end"), NARROW)))
    other = spans.select(
        *KEY, F.col("start").alias("__s"), F.col("end").alias("__e"),
        F.explode(_cells(F.col("start"), F.col("end"), NARROW)).alias("cell"))
    hit = spread.join(other, [*KEY, "cell"]).where(
        (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end"))).select(*KEY, "start", "end", "role")
    return parts.join(hit.distinct(), [*KEY, "start", "end", "role"], "left_anti")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts (weak, role, start, scope) with the other roles found within reach."""
    cell = F.floor(F.col("start") / reach).cast("long")
    heads = parts.groupBy(*KEY, "scope", cell.alias("cell"), F.col("role").alias("other")).agg(
        F.min("start").alias("first"), F.max("start").alias("last"))
    asked = parts.where("weak AND kind <> ''").withColumn(
        "cell", F.explode(F.sequence(cell - 1, cell + 1)))
    near = (F.abs(F.col("first") - F.col("start")) <= reach) | (F.abs(F.col("last") - F.col("start")) <= reach)
    met = asked.join(heads, [*KEY, "scope", "cell"]).where((F.col("other") != F.col("role")) & near)
    return met.groupBy(*KEY, "start", "end", "kind", "role").agg(F.array_sort(F.collect_set("other")).alias("found"))


def find(documents: DataFrame, *, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``added`` spans (start, rank, end, kind).

    Every text is read whole; a null text is an empty one. Positions are code points, ends
    exclusive. Weak parts that overlap a strong span are left out; of equal weak spans one is
    added. Repeated rows, also with a null doc_id, each get the same spans; further columns are
    ignored; an empty table gives no rows.
    """
    text = text_of(F.col("text"))
    key = row_key(documents)
    read = documents.select(*key, text.alias("text")).select(
        *KEY, strong_spans(F.col("text")).alias("base"), weak_parts(F.col("text")).alias("weak"), "text")
    several = F.size(F.array_distinct(F.concat(
        F.transform("weak", lambda w: w["role"]),
        F.transform("base", lambda b: _role(b["kind"]))))) > 1
    asks = F.exists("weak", lambda w: w["kind"] != "") & several
    rows = cut_lineage(read.select(
        *KEY, "base", F.when(asks, F.col("weak")).alias("weak"),
        F.when(asks, matches(F.col("text"), BREAK)).alias("breaks"),
        F.length("text").cast("long").alias("length")))

    # Null ids become text in the key, so that plain equality joins them.
    named = [F.coalesce(F.col(k).cast("string"), F.lit("null")).alias(k) for k in KEY]
    some = rows.where("weak IS NOT NULL").select(*named, "base", "weak", "breaks", "length").dropDuplicates(KEY)
    base = some.select(*KEY, F.explode("base").alias("b")).select(*KEY, "b.start", "b.end", "b.kind")
    weak = some.select(*KEY, F.explode("weak").alias("w")).select(*KEY, "w.*")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("breaks", lambda x: x["end"]))
    ends = F.concat(F.transform("breaks", lambda x: x["end"]), F.array(F.col("length")))
    scopes = some.select(*KEY, F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("s")).select(
        *KEY, "s.start", "s.end")
    parts = clear_of(weak, base).select(*KEY, "start", "end", "role", "kind", F.lit(True).alias("weak")).unionByName(
        base.select(*KEY, "start", "end", _role(F.col("kind")).alias("role"), "kind", F.lit(False).alias("weak")))
    met = linked(in_scopes(parts, scopes), reach).where(
        F.when(F.col("role") == "identifier", F.array_contains("found", "secret")).otherwise(F.size("found") > 0))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = met.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(
        "start", rank.alias("rank"), "end", "kind"))).cast(SPAN).alias("added"))
    nothing = F.array().cast(SPAN)
    return rows.select(F.col("__k0").alias("doc_id"), *named, "base").join(added, KEY, "left").select(
        "doc_id", "base", F.coalesce("added", nothing).alias("added"))
