"""Benchmark passages in documents, also reworded, by latent semantic retrieval.

Benchmark items come in blocks of ``ITEMS``, so memory does not grow with the benchmark. For
a block, the words of its items are the terms (any other word scores 0 against every item);
words that stand in many items are stop words, terms without weight. Documents are read once
into positions of terms, from which all that follows is decided. Over all their passages come document frequencies, then a randomised singular value
decomposition of the TF-IDF matrix: each pass multiplies it by a thin matrix where the
passages are and sums the small products by term. Every window of every document is compared
by cosine in that space with every item of whose terms its part of the text has enough at all;
what is near enough must share a long common subsequence of words with the item and, when reworded,
its answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import empty
from voxtally.session import cut_lineage

ITEMS = 2000
PASSAGE, STEP = 32, 8  # words of a passage, words from one window to the next
WINDOWS = (16, 32)  # words of the windows compared: short items drown in long windows
RANK, POWER = 24, 1
STOP_SHARE, STOP_ITEMS = 0.05, 20
COSINE = 0.5
COPIED, REWORDED, ANSWERED = 0.75, 0.55, 0.8
BROADCAST_IDS = 1_000_000  # 8 MB of ids
TOGETHER = 1_000_000  # positions of words that are worked on at once
FOUND = "doc_id bigint, item_id bigint, start bigint, stop bigint, cosine double, shared double, answered double"
_OUTER = b".,;:!?\"'()[]{}<>"


def plain(text: bytes | None) -> list[bytes]:
    """Lower-cased words without signs around them; signs alone are no word."""
    return [w for w in (x.strip(_OUTER) for x in (text or b"").lower().split()) if w]


def answer_of(text: bytes) -> list[bytes]:
    """The words of the last sentence or line of an item, or of all of it if there is one."""
    parts = [plain(p) for p in text.replace(b"?", b".").replace(b"!", b".").replace(b"\n", b".").split(b".")]
    parts = [p for p in parts if len(p) > 2]
    return parts[-1] if parts else plain(text)


def common(masks: dict, other) -> int:
    """Length of the longest common subsequence, all rows of a column in one number.

    ``masks``: of the first sequence, the positions of each element as bits.
    """
    n = masks[None]
    full = (1 << n) - 1
    row = full
    for x in other:
        m = masks.get(x)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def masks_of(items) -> dict:
    out: dict = {None: len(items)}
    for i, x in enumerate(items):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def common_each(starts: np.ndarray, marks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``common`` of many pairs at once, each of a first sequence of at most 64 elements.

    ``marks``: for each element of the second sequences, one after the other, its positions in
    the first one as bits, none 0; ``starts``: where each pair's begin, the end last.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin, left = starts[:-1][order], -sizes[order]
    full = ~np.uint64(0) >> (np.uint64(64) - lengths[order].astype(np.uint64))
    row = full.copy()
    for k in range(int(sizes.max(initial=0))):
        active = np.searchsorted(left, -k)  # pairs with more than k elements
        x = row[:active]
        hit = x & marks[begin[:active] + k]
        row[:active] = (x + hit) | (x - hit)
    out = np.empty(len(order), np.int64)
    out[order] = lengths[order] - np.bitwise_count(row & full)
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once; for long arrays of numbers faster than ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


class Block:
    """Some items with their terms."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.words = [plain(t) for _, t in items]
        self.answers = [answer_of(t) for _, t in items]
        seen: dict[bytes, int] = {}
        for words in self.words:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
        most = STOP_SHARE * len(items) if len(items) >= STOP_ITEMS else len(items)
        terms = sorted({
            w for words in self.words
            for w in ([x for x in words if seen[x] <= most] or words)  # no item loses every word
        })
        self.terms = {w: i for i, w in enumerate(terms)}
        # Stop words, and words that only an answer's other splitting makes, are numbered after the
        # terms, so that whole items and answers can be compared where terms stand in a text.
        rest = sorted({w for words in [*self.words, *self.answers] for w in words} - set(terms))
        self.numbers = self.terms | {w: i for i, w in enumerate(rest, len(terms))}
        self.sequences = [[self.terms[w] for w in words if w in self.terms] for words in self.words]
        # Terms in order without which an item cannot be found, were every other word of it there.
        self.enough = [
            max(1, next(c for c in range(len(words) + 1) if c / max(1, len(words)) >= REWORDED or c == len(words)) - len(words) + len(own))
            for words, own in zip(self.words, self.sequences)
        ]


class _Terms(dict):
    """Raw word to term, -1 for none; forgets when it has met too many words."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[raw] = self.terms.get(raw.strip(_OUTER), -1)
        return value


def _occurrences(documents: DataFrame, block: Block) -> DataFrame:
    """``doc_id``, ``words`` (their number), ``at``, ``term``: positions of terms, and of stop
    words under the numbers beyond the terms, in each document that has a term."""
    numbers, d = block.numbers, len(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(numbers)
        kind = pa.list_(pa.int32())
        for batch in batches:
            ids, sizes, at, term = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary())):
                words = (text.as_py() or b"").lower().split()
                found = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                where = np.flatnonzero(found >= 0)
                if np.any(found[where] < d):
                    ids.append(doc_id.as_py())
                    sizes.append(len(words))
                    at.append(where.astype(np.int32))
                    term.append(found[where])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(at, kind), pa.array(term, kind)],
                names=["doc_id", "words", "at", "term"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, words int, at array<int>, term array<int>")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def _passages(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Passage number and term of every occurrence of the ``d`` terms in a batch, and the number
    of passages.

    Passages do not overlap here; a repeated term within one counts once.
    """
    at, term = batch.column("at"), batch.column("term")
    lengths = np.diff(at.offsets.to_numpy())
    at, term = at.flatten().to_numpy(), term.flatten().to_numpy()
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    own = term < d
    text, at, term = np.repeat(np.arange(len(lengths)), lengths)[own], at[own], term[own]
    count = np.zeros(len(lengths), np.int64)
    count[text] = at // PASSAGE + 1  # the last occurrence of a text has the last say
    base = np.cumsum(count) - count
    keys = _distinct(((base[text] + at // PASSAGE) << 32) | term)
    return keys >> 32, keys & 0xFFFFFFFF, int(count.sum())


def _frequencies(found: DataFrame, d: int) -> np.ndarray:
    """Inverse passage frequencies of the terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(d + 1, np.int64), 0
        for batch in batches:
            _, terms, n = _passages(batch, d)
            total[:d] += np.bincount(terms, minlength=d)
            passages += n
        total[d] = passages
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(total)], names=["term", "n"])

    counts = np.zeros(d + 1)
    for r in found.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return np.log1p(counts[d] / np.maximum(counts[:d], 1)).astype(np.float32)


def _product(found: DataFrame, weights: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """A'A thin, with A the passages by terms with unit rows: one small row per term."""
    d, k = thin.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, k))
        for batch in batches:
            rows, terms, _ = _passages(batch, d)
            for part in range(0, len(rows), 1 << 18):  # bounds the dense products
                r, t = rows[part : part + (1 << 18)], terms[part : part + (1 << 18)]
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                w = weights[t]
                norms = np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), np.diff(np.r_[starts, len(r)]))
                w = w / np.maximum(norms, 1e-9)
                y = np.add.reduceat(w[:, None] * thin[t], starts)
                spread = w[:, None] * np.repeat(y, np.diff(np.r_[starts, len(r)]), axis=0)
                order = np.argsort(t, kind="stable")
                firsts = np.flatnonzero(np.r_[True, np.diff(t[order]) != 0])
                out[t[order][firsts]] += np.add.reduceat(spread[order], firsts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d)), pa.array(list(out), pa.list_(pa.float64()))], names=["term", "row"])

    parts = found.mapInArrow(run, "term bigint, row array<double>")
    sums = parts.groupBy("term").agg(F.array(*[F.sum(F.get("row", F.lit(i))) for i in range(k)]).alias("row"))
    out = np.zeros((d, k))
    for r in sums.collect():  # terms of one block by rank, whatever the corpus
        out[r["term"]] = r["row"]
    return out


def space(found: DataFrame, weights: np.ndarray, rank: int = RANK, power: int = POWER) -> np.ndarray:
    """Leading right singular vectors of the passages, from ``power`` products with A'A.

    The last product serves twice, as range and, through its Nystroem core, as the small
    problem that turns the basis into singular vectors, so no further pass is needed.
    """
    d = len(weights)
    k = min(rank, d)
    product = np.random.default_rng(8).standard_normal((d, k))
    for _ in range(power):
        basis, _ = np.linalg.qr(product)
        product = _product(found, weights, basis.astype(np.float32))
    shift = 1e-6 * np.linalg.norm(product) + 1e-12  # keeps the core positive
    product += shift * basis
    core = basis.T @ product
    root = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(k))
    return np.linalg.svd(np.linalg.solve(root, product.T).T, full_matrices=False)[0].astype(np.float32)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _candidates(found: DataFrame, block: Block, weights: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``stop`` (words), ``cosine``, ``shared``, ``answered``
    of every stretch near an item that the words of both confirm."""
    terms = weights[:, None] * vectors
    queries = _units(np.stack([terms[s].sum(axis=0) if s else np.zeros(terms.shape[1]) for s in block.sequences]))
    queries = queries.astype(np.float32)
    sequences = block.sequences
    masks = [masks_of(s) for s in sequences]
    d, ids = len(weights), block.ids
    whole, answers = ([masks_of([block.numbers[w] for w in words]) for words in side]
                      for side in (block.words, block.answers))
    longest = max(map(len, block.words), default=0)
    # Which items hold a term, and how often: flat lists by term.
    held = sorted((t, i) for i, own in enumerate(sequences) for t in own)
    items_of = np.array([i for _, i in held], np.int64)
    first = np.searchsorted([t for t, _ in held], np.arange(len(weights) + 1))
    enough = np.array(block.enough)

    def possible(parts: np.ndarray, term: np.ndarray) -> dict[int, np.ndarray]:
        """Per part of a text the items of whose terms it has enough, anywhere; no other can be
        found in it. ``parts`` and ``term`` hold one entry per occurrence."""
        out: dict[int, np.ndarray] = {}
        own = _distinct(parts * len(weights) + term)
        parts, term = own // len(weights), own % len(weights)
        last, step = int(parts[-1]) + 1 if len(parts) else 0, max(1, (1 << 22) // len(sequences))
        for begin in range(0, last, step):
            low, high = np.searchsorted(parts, (begin, begin + step))
            chosen = term[low:high]
            at, n = first[chosen], first[chosen + 1] - first[chosen]
            held_by = items_of[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]
            counts = np.bincount(
                np.repeat(parts[low:high] - begin, n) * len(sequences) + held_by,
                minlength=min(step, last - begin) * len(sequences)).reshape(-1, len(sequences))
            part, item = np.nonzero((counts > 0) & (counts >= enough))
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            out |= {begin + int(part[k]): item[k:e] for k, e in zip(starts, [*starts[1:], len(part)])}
        return out

    # Per item its words as marks by number: one byte for each word of the block.
    size = len(block.numbers)
    marks = np.zeros((len(sequences), size), bool)
    for i, words in enumerate(block.words):
        marks[i, [block.numbers[w] for w in words]] = True
    full = np.array([int(np.ceil(REWORDED * len(words) - 1e-9)) for words in block.words])

    def flat(side: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(item * size + number, positions as bits) of items of at most 64 words, ascending."""
        rows = sorted((i * size + w, bits) for i, own in enumerate(side) if own[None] <= 64
                      for w, bits in own.items() if w is not None)
        return np.array([k for k, _ in rows], np.int64), np.array([bits for _, bits in rows], np.uint64)

    flat_terms, flat_words = flat(masks), flat(whole)
    term_sizes, word_sizes = (np.array([own[None] for own in side], np.int64) for side in (masks, whole))

    def in_order(side: list[dict], flat: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, least: np.ndarray,
                 items: np.ndarray, low: np.ndarray, high: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """Which pairs of an item and a stretch of ``sequence`` have ``least`` of its words in order."""
        kept, pairs, keys, held = np.zeros(len(items), bool), [], [], 0

        def compare() -> None:
            if pairs:
                starts = np.cumsum([0, *map(len, keys)])
                bits = flat[1][np.searchsorted(flat[0], np.concatenate(keys))]
                kept[pairs] = common_each(starts, bits, sizes[items[pairs]]) >= least[items[pairs]]
                pairs.clear()
                keys.clear()

        for k, (item, a, b) in enumerate(zip(items.tolist(), low.tolist(), high.tolist())):
            some = sequence[a:b]
            some = some[marks[item, some]]
            if len(some) >= least[item]:
                if sizes[item] <= 64:
                    pairs.append(k)
                    keys.append(some + item * size)
                    held += len(some)
                else:
                    kept[k] = common(side[item], some.tolist()) >= least[item]
            if held > TOGETHER:
                compare()
                held = 0
        compare()
        return kept

    # Whatever a window can find lies within one of the overlapping parts of a text.
    reach = -(-(max(WINDOWS) + 2 * longest) // STEP) * STEP

    def holding(rows: list[tuple[np.ndarray, np.ndarray]], wanted: list[dict[int, np.ndarray]]) -> list[dict[int, np.ndarray]]:
        """Of these, items that the part as a whole has in order; none of its windows has more."""
        found = [(t, p, items) for t, own in enumerate(wanted) for p, items in own.items()]
        if not found:
            return wanted
        n = np.array([len(items) for _, _, items in found])
        text, part = (np.repeat([x[j] for x in found], n) for j in (0, 1))
        item = np.concatenate([items for _, _, items in found])
        for side, flat, sizes, least, content, beyond in (
                (masks, flat_terms, term_sizes, enough, True, 0),
                (whole, flat_words, word_sizes, full, False, max(WINDOWS) + longest)):
            if not len(item):
                break
            low, high, sequence, base = np.empty_like(item), np.empty_like(item), [], 0
            firsts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            for a, b in zip(firsts, [*firsts[1:], len(text)]):
                at, term = rows[text[a]]
                if content:
                    own = term < d
                    at, term = at[own], term[own]
                begin = part[a:b] * reach
                low[a:b] = np.searchsorted(at, begin) + base
                high[a:b] = np.searchsorted(at, begin + 2 * reach + beyond) + base
                sequence.append(term)
                base += len(term)
            kept = in_order(side, flat, sizes, least, item, low, high, np.concatenate(sequence).astype(np.int64))
            text, part, item = text[kept], part[kept], item[kept]
        out: list[dict[int, np.ndarray]] = [{} for _ in rows]
        firsts = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (part[1:] != part[:-1])]) if len(item) else []
        for a, b in zip(firsts, [*firsts[1:], len(item)]):
            out[text[a]][int(part[a])] = item[a:b]
        return out

    def parts(all_at: np.ndarray, all_term: np.ndarray, wanted: dict[int, np.ndarray]) -> Iterator[tuple]:
        content = all_term < d
        at, term = all_at[content], all_term[content]
        for part, items in wanted.items():
            begin = part * reach
            low, high = np.searchsorted(at, (begin, begin + 2 * reach))
            if high > low:
                for item, start, stop, cosine in near(at[low:high] - begin, term[low:high], items):
                    start, stop = start + begin, stop + begin
                    low_, high_ = np.searchsorted(all_at, (start, stop))
                    region = all_term[low_:high_]
                    answer_region, region = region.tolist(), region[marks[item, region]].tolist()
                    shared = common(whole[item], region) / max(1, whole[item][None])
                    if shared >= REWORDED:
                        answered = common(answers[item], answer_region) / max(1, answers[item][None])
                        if shared >= COPIED or answered >= ANSWERED:
                            yield ids[item], start, stop, cosine, shared, answered

    def wanted(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[int, np.ndarray]]:
        """Per text its parts that can hold an item, with those items; all texts at once."""
        owners, numbers, terms_, n_parts = [], [], [], [0]
        for all_at, all_term in rows:
            content = all_term < d
            at, term = all_at[content].astype(np.int64), all_term[content]
            count = len(range(0, max(1, int(at[-1]) - reach + 1), reach))
            for back in (0, 1):  # an occurrence lies in the part that starts before it and the one before
                part = at // reach - back
                inside = (part >= 0) & (part < count)
                numbers.append(part[inside] + n_parts[-1])
                terms_.append(term[inside])
            owners.append(n_parts[-1])
            n_parts.append(n_parts[-1] + count)
        out: list[dict[int, np.ndarray]] = [{} for _ in rows]
        if rows:
            texts = np.repeat(np.arange(len(rows)), np.diff(n_parts))
            for part, items in possible(np.concatenate(numbers), np.concatenate(terms_).astype(np.int64)).items():
                out[texts[part]][part - owners[texts[part]]] = items
        return out

    def near(at: np.ndarray, term: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        cell = at // STEP
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sums = np.zeros((int(cell[-1]) + max(WINDOWS) // STEP, terms.shape[1]), np.float32)
        sums[cell[starts]] = np.add.reduceat(terms[term], starts)
        for span in (words // STEP for words in WINDOWS):
            windows = sum(sums[i : len(sums) - span + 1 + i] for i in range(span))
            used = np.flatnonzero(np.abs(windows).sum(axis=1) > 1e-6)
            for part in range(0, len(used), 4096):
                yield from compared(at, term, windows, used[part : part + 4096], span, items)

    def compared(at, term, windows, chosen, span, items) -> Iterator[tuple[int, int, int, float]]:
        scores = _units(windows[chosen]) @ queries[items].T
        hit_window, hit_item = np.nonzero(scores >= COSINE)
        for column in np.unique(hit_item):
            item, own = items[column], hit_window[hit_item == column]
            for run in np.split(own, np.flatnonzero(np.diff(chosen[own]) > span) + 1):
                start = max(0, int(chosen[run[0]]) * STEP - longest)
                stop = (int(chosen[run[-1]]) + span) * STEP + longest
                low, high = np.searchsorted(at, (start, stop))
                own_terms = term[low:high]
                own_terms = own_terms[marks[item, own_terms]]
                if len(own_terms) >= enough[item] and common(masks[item], own_terms.tolist()) >= enough[item]:
                    yield int(item), start, stop, float(scores[run, column].max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = list(zip(_lists(batch.column("at")), _lists(batch.column("term"))))
            ids_, sizes_ = batch.column("doc_id").to_pylist(), batch.column("words").to_pylist()
            turn = np.cumsum([len(at) for at, _ in rows]) // TOGETHER
            firsts = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]).tolist() if rows else []
            for a, b in zip(firsts, [*firsts[1:], len(rows)]):
                chosen = holding(rows[a:b], wanted(rows[a:b]))
                for doc_id, n, (at, term), items in zip(ids_[a:b], sizes_[a:b], rows[a:b], chosen):
                    out += [(doc_id, item, start, min(stop, n), *rest) for item, start, stop, *rest in parts(at, term, items)]
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "item_id", "start", "stop", "cosine", "shared", "answered"])

    return found.mapInArrow(run, FOUND)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and item found in it: ``doc_id``, ``item_id``, ``start``, ``stop`` (the
    words searched), ``cosine``, ``shared``, ``answered``; the best stretch of each.

    ``shared`` and ``answered`` are the shares of the item's words, and of its last
    sentence's, that the stretch has in the same order. An item is found when ``shared`` is
    at least ``COPIED``, or at least ``REWORDED`` with ``answered`` at least ``ANSWERED``.

    Null or empty texts hold and match nothing; items alike are found alike; repeated
    documents come out once; either table may be empty; further columns are left out.
    """
    items = benchmark.where(F.length("text") > 0).select("item_id", "text")
    blocks = max(1, -(-items.count() // ITEMS))
    results = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        block = Block([(r["item_id"], r["text"].encode()) for r in rows])
        if not block.terms:
            continue
        found = cut_lineage(_occurrences(documents, block))
        weights = _frequencies(found, len(block.terms))
        vectors = space(found, weights)
        results.append(cut_lineage(_candidates(found, block, weights, vectors)))
    if not results:
        return empty(documents.sparkSession, FOUND)
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    best = out.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("shared", "answered", "cosine", "start", "stop")).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.stop", "b.cosine", "b.shared", "b.answered")


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` less those that hold an item; rows that share an id go together."""
    gone = cut_lineage(leaks(documents, benchmark).select(F.col("doc_id").alias("__gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return documents.join(side, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
