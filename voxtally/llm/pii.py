"""Personal data: exact patterns, and a semi-Markov conditional random field beside them.

The field scores whole candidate spans of one to six tokens by features of the span (digit
groups, signs, check digit, the word before) and chooses boundaries and kinds of a stretch
of text together, by dynamic programming over spans of bounded length. It is trained here by
maximum likelihood on the exact patterns' spans in a bounded sample, without being told
which pattern matched, so it also finds forms the patterns miss, such as a phone number
without its country code. A token without a digit or an at sign never starts or ends a span
of any kind, so texts fall apart into short stretches that are solved exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Training only: texts drawn, and the longest stretch used (a table of numbers teaches nothing
# about single spans). Every stretch of every text is searched, whatever its length.
TRAIN_DOCUMENTS, TRAIN_TOKENS = 600, 64
MAX_TOKENS = 6
EPOCHS, RATE, DECAY = 12, 0.2, 1e-4
# Left out of every other training step, so that the rest of a span has to speak for it too.
_DROPPED = ("plus", "domain", "tokens2", "tokens3", "tokens4", "groups1", "groups2-3", "groups4")
SURE = 0.9
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Where a digit precedes, an attempt has failed already or been part of a match.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = " \t\n\x0b\x0c\r"
_OUTER = ".,;:!?\"'<>[]{}"

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The exact patterns' spans by kind and start, in code points; ends are exclusive."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# --- the field -------------------------------------------------------------------------

_FEATURES = (
    "bias", "tokens1", "tokens2", "tokens3", "tokens4", "tokens5", "tokens6",
    "digits0", "digits1-3", "digits4-6", "digits7-8", "digits9-12", "digits13-19", "digits20+",
    "letters0", "letters1-2", "letters3+", "at0", "at1", "at2+", "domain", "local",
    "octets", "parts4", "luhn", "numeric", "plus", "parens", "dashes", "dots", "spaces",
    "tail34", "tail3", "tail4", "groups1", "groups2-3", "groups4", "groups5+", "long group",
    "cue phone", "cue mail", "cue card", "cue net", "odd signs",
)
_AT = {name: i for i, name in enumerate(_FEATURES)}
_CUES = {
    "cue phone": {"tel", "phone", "call", "mobile", "fon", "telefon", "fax"},
    "cue mail": {"mail", "email", "e-mail", "contact", "write"},
    "cue card": {"card", "visa", "karte", "tarjeta", "carte"},
    "cue net": {"ip", "host", "server", "address"},
}


def _bucket(n: int, names: tuple[tuple[int, str], ...]) -> str:
    return next(name for most, name in names if n <= most)


def _features(span: str, before: str, tokens: int) -> tuple[int, ...]:
    digits = _digits(span)
    letters = sum(c.isalpha() for c in span)
    ats = span.count("@")
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    out = ["bias", f"tokens{tokens}", _bucket(len(digits), (
        (0, "digits0"), (3, "digits1-3"), (6, "digits4-6"), (8, "digits7-8"), (12, "digits9-12"),
        (19, "digits13-19"), (1 << 60, "digits20+")))]
    out.append(_bucket(letters, ((0, "letters0"), (2, "letters1-2"), (1 << 60, "letters3+"))))
    out.append(_bucket(ats, ((0, "at0"), (1, "at1"), (1 << 60, "at2+"))))
    if ats == 1:
        local, _, domain = span.partition("@")
        out += ["domain"] * bool(_DOMAIN.fullmatch(domain)) + ["local"] * (bool(local) and set(local) <= _LOCAL)
    parts = span.split(".")
    if len(parts) == 4 and all(p and len(_digits(p)) == len(p) for p in parts):
        out += ["parts4"] + ["octets"] * all(map(_small, parts))
    out += ["luhn"] * (13 <= len(digits) <= 19 and luhn(digits))
    out += ["numeric"] * (bool(digits) and not letters)
    out += ["plus"] * span.startswith("+") + ["parens"] * ("(" in span and ")" in span)
    out += ["dashes"] * ("-" in span) + ["dots"] * ("." in span) + ["spaces"] * (tokens > 1)
    out += ["tail34"] * (groups[-2:] == [3, 4]) + ["tail3"] * (groups[-1:] == [3]) + ["tail4"] * (groups[-1:] == [4])
    out.append(_bucket(len(groups), ((1, "groups1"), (3, "groups2-3"), (4, "groups4"), (1 << 60, "groups5+"))))
    out += ["long group"] * (max(groups, default=0) > 8)
    word = before.lower().strip(_OUTER)
    out += [cue for cue, cues in _CUES.items() if word in cues]
    out += ["odd signs"] * any(not c.isalnum() and c not in " .()+-@_%" for c in span)
    return tuple(_AT[name] for name in out)


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens with a digit or an at sign, trimmed of outer signs."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    for anchor in _ANCHOR.finditer(text):
        at = anchor.start()
        if at < end:
            continue
        start = at
        while start > max(end, 0) and text[start - 1] not in _SPACES:
            start -= 1
        near = out and not text[end:start].strip(_SPACES) and "\n" not in text[end:start]
        end = _TOKEN.match(text, start).end()
        left, right = start, end
        while left < right and text[left] in _OUTER:
            left += 1
        while right > left and text[right - 1] in _OUTER:
            right -= 1
        if near:
            out[-1].append((left, right))
        else:
            out.append([(left, right)])
    return out


def _segments(text: str, run: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, ...]]:
    out = {}
    for i, (start, _) in enumerate(run):
        before = text[max(0, start - 24) : start].split()
        for n in range(1, min(MAX_TOKENS, len(run) - i) + 1):
            out[i, i + n] = _features(text[start : run[i + n - 1][1]], before[-1] if before else "", n)
    return out


def _scores(segments, weights: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    return {key: weights[:, list(f)].sum(axis=1) for key, f in segments.items()}


def _sums(scores, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums. A token outside any span scores 0."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    for j in range(1, n + 1):
        terms = [forward[j - 1]]
        for i in range(max(0, j - MAX_TOKENS), j):
            terms += list(forward[i] + scores[i, j])
        forward[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [backward[i + 1]]
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            terms += list(backward[j] + scores[i, j])
        backward[i] = np.logaddexp.reduce(terms)
    return forward, backward


def _gold(text: str, run: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    starts = {start: i for i, (start, _) in enumerate(run)}
    ends = {end: i + 1 for i, (_, end) in enumerate(run)}
    low, high = run[0][0], run[-1][1]
    return {
        (starts[start], ends[end]): KINDS.index(kind)
        for kind, start, end in base_spans(text[low:high])
        for start, end in [(start + low, end + low)]
        if start in starts and end in ends and 0 < ends[end] - starts[start] <= MAX_TOKENS
    }


def train(texts: list[str]) -> np.ndarray:
    """Weights by kind and feature; without a text all are zero but the bias, which says no."""
    runs = []
    for text in texts:
        for run in stretches(text):
            segments, gold = _segments(text, run), _gold(text, run)
            taken: set[int] = set()
            for i, j in sorted(gold):
                if taken & set(range(i, j)):
                    del gold[i, j]  # a field has no overlapping spans; the first stays
                taken |= set(range(i, j))
            runs.append((len(run), segments, gold))
    weights = np.zeros((len(KINDS), len(_FEATURES)))
    weights[:, 0] = -3.0
    order, dropped = np.random.default_rng(6), {_AT[name] for name in _DROPPED}
    for epoch in range(EPOCHS):
        step = RATE / (1 + 0.3 * epoch)
        for r in order.permutation(len(runs)):
            n, segments, gold = runs[r]
            if n > TRAIN_TOKENS:
                continue
            if order.random() < 0.5:
                segments = {key: tuple(i for i in f if i not in dropped) for key, f in segments.items()}
            scores = _scores(segments, weights)
            forward, backward = _sums(scores, n)
            weights *= 1 - step * DECAY
            for (i, j), f in segments.items():
                p = np.exp(np.minimum(forward[i] + scores[i, j] + backward[j] - forward[n], 0))
                if (i, j) in gold:
                    p[gold[i, j]] -= 1
                for k in np.flatnonzero(np.abs(p) > 1e-6):
                    weights[k, list(f)] -= step * p[k]
    return weights


def field_spans(text: str, weights: np.ndarray) -> list[Span]:
    """Spans of the best joint segmentation whose own probability is at least ``SURE``."""
    out: list[Span] = []
    for run in stretches(text):
        n, segments = len(run), _segments(text, run)
        scores = _scores(segments, weights)
        forward, backward = _sums(scores, n)
        best, step = np.zeros(n + 1), [(0, -1)] * (n + 1)
        for j in range(1, n + 1):
            best[j], step[j] = best[j - 1], (j - 1, -1)
            for i in range(max(0, j - MAX_TOKENS), j):
                k = int(np.argmax(scores[i, j]))
                if best[i] + scores[i, j][k] > best[j]:
                    best[j], step[j] = best[i] + scores[i, j][k], (i, k)
        j = n
        while j:
            i, k = step[j]
            if k >= 0 and forward[i] + scores[i, j][k] + backward[j] - forward[n] >= np.log(SURE):
                out.append((KINDS[k], run[i][0], run[j - 1][1]))
            j = i
    return sorted(out, key=lambda s: s[1])


def all_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    ends = sorted((start, end) for _, start, end in base)
    added = []
    for kind, start, end in field_spans(text, weights):
        if start < end and not any(s < end and start < e for s, e in ends):
            added.append((kind, start, end, False))
    return sorted([(*s, True) for s in base] + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def sample(documents: DataFrame, most: int = TRAIN_DOCUMENTS) -> list[str]:
    """At most ``most`` texts with a digit or an at sign, chosen by a hash of the id.

    A share of the hash range is taken that holds about ``most`` texts, so no task sends the
    driver many more than its part of them.
    """
    rows = documents.where(F.col("text").rlike("[0-9@]")).select(
        "text", F.pmod(F.xxhash64("doc_id"), F.lit(2**32)).alias("__o"))
    share = min(1.0, most / max(1, rows.count()))
    chosen = rows.where(F.col("__o") < F.lit(int(share * 2**32)))
    return [r["text"] for r in chosen.orderBy("__o", "text").limit(most).collect()]


def find(documents: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base), one row per row of ``documents``.

    Spans come by kind as listed, then start; those the field adds are not ``base``, and stand
    only where they overlap no base span. Offsets are code points of the whole text, ends
    exclusive. A null or empty text has no spans; repeated rows have equal ones; other
    columns are left out; an empty table gives an empty one.
    """
    if weights is None:
        weights = train(sample(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            found = []
            for value in batch.column("text"):
                text = value.as_py()
                hit = text and _ANCHOR.search(text)
                found.append([
                    {"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in all_spans(text, weights)
                ] if hit else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
