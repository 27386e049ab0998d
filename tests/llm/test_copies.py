"""Near copies, repeated passages, benchmark leaks and the pipeline against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxtally.llm import components, leaks, near_dedup, passages, shingles
from voxtally.llm.common import table
from voxtally.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """Smallest reachable id by comparing every pair."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def sentence(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def edited(draw, w, edits):
    w = list(w)
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
    return w


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


class TestShingles:
    def test_words_are_those_of_the_pattern(self):
        draw = random.Random(1)
        for _ in range(500):
            text = "".join(draw.choice("aBÉ  \x1c \t\n\x0b\x0c\r") for _ in range(draw.randrange(30)))
            assert [w.decode() for w in text.encode().lower().split()] == words(text)

    def test_sets_match_real_shingles(self):
        draw = random.Random(2)
        for n in (0, 1, 4, 5, 6, 50):
            text = " ".join(sentence(draw, n, 5))
            assert len(shingles.shingle_set(text.encode())) == len(shingle_set(text))
        assert shingles.similar(np.arange(75, dtype=np.uint64), np.arange(100, dtype=np.uint64))
        assert not shingles.similar(np.arange(74, dtype=np.uint64), np.arange(100, dtype=np.uint64))


class TestComponents:
    def test_chain_star_and_loops(self, spark):
        chain = [(i, i + 1) for i in range(40)]
        star = [(100, 100 + i) for i in range(1, 50)] + [(100, 100), (101, 100), (None, 3)]
        got = {r["key"]: r["root"] for r in components.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
        assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


class TestNearCopies:
    def test_against_brute_force(self, spark):
        draw = random.Random(4)
        rows = []
        for _ in range(12):
            base = sentence(draw, draw.randrange(30, 120))
            rows += [edited(draw, base, draw.randrange(0, 5)) for _ in range(draw.randrange(1, 9))]
        big = sentence(draw, 200)
        rows += [edited(draw, big, 2) for _ in range(150)] + [big] * 30  # one large group
        rows += [sentence(draw, n) for n in (1, 2, 4, 5, 6, 7)] + [["a", "b"], ["A", "b"], ["b", "a"]]
        texts = [" ".join(r) for r in rows] + [None, None, "", " \n"]
        ids = list(range(len(texts)))
        draw.shuffle(ids)
        data = list(zip(ids, texts))
        got = near_dedup.near_copies(documents(spark, data)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(data)
        sizes = {i: len(shingle_set(t)) for i, t in data}
        assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)

    def test_branching_below_the_node_size(self, spark, monkeypatch):
        monkeypatch.setattr(near_dedup, "NODE", 2)
        draw = random.Random(5)
        shared = sentence(draw, 40)  # half of every text, so that nodes are large and mixed
        data = [(i, " ".join(shared + sentence(draw, 40))) for i in range(60)]
        data += [(100 + i, " ".join(shared + words(data[i][1])[40:-2])) for i in range(20)]
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_copies(documents(spark, data)).collect()}
        assert got == brute_components(data)

    def test_pair_that_shares_a_branching_node_first(self, spark, monkeypatch):
        monkeypatch.setattr(near_dedup, "NODE", 2)
        draw = random.Random(12)
        shared = sentence(draw, 44)
        data = [(i, " ".join(shared + sentence(draw, 40))) for i in range(9)]
        near = words(data[0][1])
        near[50], near[70] = "e", "f"  # 70 of 90 shingles
        join = near_dedup._Join(documents(spark, [*data, (9, " ".join(near))]))
        rows = {r["rep"]: r for r in join.classes.collect()}
        first = next(i for i, (_, p) in enumerate(near_dedup._root_positions())
                     if rows[0]["tokens"][p] == rows[9]["tokens"][p])
        # All meet where both share a token first; later the two meet a pivot unlike either.
        members = [(1, i, first) for i in range(10)] + [(2, i, first + 1) for i in (0, 8, 9)]
        members += [(3, i, first + 2) for i in range(1, 9)]
        nodes = spark.createDataFrame([(n, rows[i]["key"], at, 0) for n, i, at in members],
                                      "node long, key binary, place int, used long")
        join.level(nodes, last=False)
        held = {bytes(r["key"]): bytes(r["root"]) for r in join.labels.collect()}
        assert held[bytes(rows[0]["key"])] == held[bytes(rows[9]["key"])]

    @pytest.mark.parametrize("small", [1024, 50])
    def test_many_copies_just_below_the_threshold(self, spark, monkeypatch, small):
        monkeypatch.setattr(near_dedup, "APART", 3)
        monkeypatch.setattr(near_dedup, "SMALL", small)  # at 50 the sketch has to do
        tried = []
        confirm = near_dedup._Join.confirm
        monkeypatch.setattr(near_dedup._Join, "confirm", lambda join, pairs: (
            tried.append(pairs.count()), confirm(join, pairs))[1])
        draw = random.Random(14)
        base = sentence(draw, 100)
        copies = [[*base[:i], f"x{i}", *base[i + 1 : 50 + i], f"y{i}", *base[51 + i :]] for i in range(6, 42)]
        copies += [edited(draw, copies[i % 36], 1) for i in range(0, 60, 5)]
        data = [(i, " ".join(w)) for i, w in enumerate(copies)]
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_copies(documents(spark, data)).collect()}
        assert got == brute_components(data)
        if small == 1024:  # some 1100 pairs are at 0.65 to 0.75 and need no confirmation
            assert sum(tried) < 5 * len(data)

    def test_a_tile_gives_fewer_links_than_sets(self):
        draw = random.Random(15)
        base = sentence(draw, 100)
        data = [(i, " ".join(edited(draw, base, 1 + draw.randrange(3)))) for i in range(40)]
        data += [(40 + i, " ".join(sentence(draw, 60))) for i in range(5)]
        sets = [shingles.shingle_set(t.encode()) for _, t in data]
        factors = shingles.multipliers(near_dedup.TOKENS)
        rows = [{"key": shingles.set_key(x), "root": shingles.set_key(x), "major": b"none", "n": len(x), "place": 0,
                 "branching": 0, "tokens": shingles.minwise(x, factors).tolist(), "sketch": shingles.sketch(x).tolist(),
                 "members": x.tobytes(), "node": 1, "low": (shingles.minwise(x, factors) & 0x7F).tolist()} for x in sets]
        tile = pa.Table.from_pylist([r | {"few": few} for few in (False, True) for r in rows])
        links = near_dedup._links(tile).to_pylist()
        ids = {r["key"]: i for i, r in enumerate(rows)}
        want = brute_components(data)
        assert all(r["sure"] for r in links) and len(links) == len(want) - len(set(want.values()))
        root = {i: i for i in want}
        for r in links:
            x, y = root[ids[r["a"]]], root[ids[r["b"]]]
            root = {i: min(x, y) if c in (x, y) else c for i, c in root.items()}
        assert root == want
        near = {ids[k.as_py()] for k in near_dedup._partners(tile).column("key")}
        assert {i for i in want if list(want.values()).count(want[i]) > 1} <= near and near.isdisjoint(range(40, 45))

    def test_forest_joins_what_candidate_pairs_join(self):
        draw = random.Random(16)
        factors = shingles.multipliers(near_dedup.TOKENS)
        rows = []
        for node, many in ((3, 1), (5, 2), (8, 40), (9, 2), (12, 25)):
            base = sentence(draw, 100)
            texts = [edited(draw, base, draw.randrange(4)) if i % 3 else sentence(draw, 90) for i in range(1, many + 1)]
            sets = {shingles.set_key(x): x for x in (shingles.shingle_set(" ".join(t).encode()) for t in texts)}
            rows += [{"node": node, "key": k, "n": len(x), "low": (shingles.minwise(x, factors) & 0x7F).tolist(),
                      "sketch": shingles.sketch(x).tolist()} for k, x in sorted(sets.items())]
        table_ = pa.Table.from_pylist(rows)
        sketches = np.array([r["sketch"] for r in rows]).view(np.uint8)
        root = list(range(len(rows)))
        for i, x in enumerate(rows):
            for j, y in enumerate(rows[:i]):
                union = np.count_nonzero(sketches[i] | sketches[j])
                like = 100 * (union - np.count_nonzero(sketches[i] ^ sketches[j])) / union
                agree = sum(s == t for s, t in zip(x["low"], y["low"]))
                if x["node"] == y["node"] and agree >= near_dedup.AGREE and like >= near_dedup.LIKELY and (
                        100 * min(x["n"], y["n"]) >= 75 * max(x["n"], y["n"])):
                    root = [root[j] if r == root[i] else r for r in root]
        at = {(r["node"], r["key"]): i for i, r in enumerate(rows)}
        for rows_a_batch in (1, 7, 100):  # nodes go on from batch to batch
            out = pa.Table.from_batches(near_dedup._forest(iter(table_.to_batches(max_chunksize=rows_a_batch)))).to_pylist()
            got = list(range(len(rows)))
            for r in out:
                i, j = at[r["node"], r["a"]], at[r["node"], r["b"]]
                assert got[i] != got[j] and r["a"] < r["b"]
                got = [got[j] if x == got[i] else x for x in got]
            groups = lambda root: {frozenset(i for i, x in enumerate(root) if x == r) for r in root}
            assert groups(got) == groups(root) and len(groups(root)) < len(rows)

    def test_nodes_of_links_need_no_pairs_but_their_forest(self, spark, monkeypatch):
        tried = []
        confirm = near_dedup._Join.confirm
        monkeypatch.setattr(near_dedup._Join, "confirm", lambda join, pairs: (
            tried.append(pairs.count()), confirm(join, pairs))[1])
        monkeypatch.setattr(near_dedup._Join, "estimate", None)  # no pivots
        draw = random.Random(17)
        base = sentence(draw, 200)
        data = [(i, " ".join(edited(draw, base, 2))) for i in range(60)]
        data += [(60 + i, " ".join(base[:30] + sentence(draw, 100))) for i in range(30)]
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_copies(documents(spark, data)).collect()}
        assert got == brute_components(data)
        assert sum(tried) < 3 * len(data)

    def test_estimate_admits_pairs_at_the_threshold(self, spark):
        a = [f"w23x{i}" for i in range(3504)]
        b = [f"e23x{i // 35}" if i % 35 == 2 and i < 3500 else w for i, w in enumerate(a)]
        # 3002 of 3998 shingles, of which the sketch sees 67.5 percent
        join = near_dedup._Join(documents(spark, [(0, " ".join(a)), (1, " ".join(b))]))
        x, y = (r["key"] for r in join.classes.collect())
        assert join.estimate(spark.createDataFrame([(x, y)], "a binary, b binary")).count() == 1

    def test_children_use_new_positions_and_keep_pairs(self, spark):
        draw = random.Random(13)
        pairs = []
        for i in range(300):  # two sets that agree in three quarters of their tokens
            a = [draw.randrange(2**31) for _ in range(32)]
            other = draw.sample(range(32), 8)
            b = [-1 if p in other else x for p, x in enumerate(a)]
            pairs += [(f"a{i}".encode(), a), (f"b{i}".encode(), b)]
        classes = spark.createDataFrame(pairs, "key binary, tokens array<int>")
        nodes = classes.select(F.substring("key", 2, 9).cast("string").cast("long").alias("node"), "key",
                               F.lit(1 << 5).cast("bigint").alias("used"))
        for depth in (2, 3, 4):
            nodes = near_dedup._children(nodes, classes).transform(cut_lineage)
            assert {r[0] for r in nodes.select(F.bit_count("used")).distinct().collect()} == {depth}
        together = nodes.groupBy("node").agg(F.count_distinct("key").alias("n"), F.first("key").alias("key")).where("n = 2")
        left = together.select(F.substring("key", 2, 9)).distinct().count()
        assert left >= 0.85 * 300  # one position in two of three nodes would keep some 60 percent

    def test_one_of_each_and_odd_rows(self, spark):
        text = " ".join(f"w{i}" for i in range(30))
        rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (7, None), (8, "own words here"), (8, "others")]
        df = documents(spark, rows).withColumns({"key": F.lit("k"), "n": F.lit(1), "kept": F.lit("x"), "tokens": F.lit(0)})
        out = near_dedup.one_of_each(df)
        assert out.columns == df.columns
        got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
        assert got == [(3, text), (7, ""), (8, "others"), (8, "own words here")]
        assert near_dedup.near_copies(df.limit(0)).count() == 0


class TestPassages:
    def test_windows_cover_each_stretch_once(self):
        draw = np.random.default_rng(3)
        for _ in range(20):
            hashes = draw.integers(0, 40, 60).astype(np.uint64)
            found = passages.compact_windows(hashes, 10)
            for i in range(60):
                for j in range(i + 9, 60):
                    hit = [c for low, c, high in found if low <= i <= c <= j <= high]
                    assert len(hit) == 1 and hashes[hit[0]] == hashes[i : j + 1].min()
        assert len(passages.compact_windows(np.zeros(100_000, np.uint64))) < 10_000

    def test_planted_passages(self, spark):
        draw = random.Random(6)
        passage, other = sentence(draw, 60, 5000), sentence(draw, 90, 5000)
        rows, planted = [], {}
        for i in range(120):
            w = sentence(draw, draw.randrange(60, 300), 5000)
            if i % 3 == 0:
                at = draw.randrange(len(w))
                w[at:at] = passage
                planted[i] = (at, at + 60)
            elif i % 7 == 0:
                w += edited(draw, other, 1)  # any two share at least 0.79 of their shingles
            rows.append((i, " ".join(w)))
        rows += [(200, rows[1][1]), (201, None), (202, ""), (203, "short"), (None, rows[2][1]), (204, "x " * 4000)]
        got = passages.repeated_passages(documents(spark, rows).withColumns({"rep": F.lit(1), "v": F.lit("c")})).collect()
        found = {}
        for r in got:
            found.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["other_id"]))
            assert r["similarity"] >= 0.75 and r["stop"] - r["start"] >= passages.WORDS
        for i, (start, stop) in planted.items():
            if i:
                assert any(s <= start and stop <= e and o == 0 for s, e, o in found[i]), i
        near = {i for i in range(120) if i % 3 and i % 7 == 0}
        assert len(near & set(found)) >= 0.9 * (len(near) - 1)
        assert found[200] == [(0, len(words(rows[1][1])), 1)]
        clean = set(range(120)) - set(planted) - near
        assert not clean & set(found) and not {201, 202, 203, 204} & set(found)

    def test_near_passages_at_the_threshold(self, spark):
        draw = random.Random(14)
        rows = []
        for i in range(300):
            passage = sentence(draw, 50, 10**6)
            near = list(passage)
            near[22], near[23] = "e", "f"  # 40 of 52 shingles, and one alignment only
            for doc_id, own in ((2 * i, passage), (2 * i + 1, near)):
                rows.append((doc_id, " ".join(sentence(draw, 40, 10**6) + own + sentence(draw, 40, 10**6))))
        found = {r["doc_id"] for r in passages.repeated_passages(documents(spark, rows)).collect()}
        assert len(found) >= 298

    def test_a_smaller_document_with_a_part_hides_no_passage(self, spark):
        draw = random.Random(21)
        rows = []
        for i in range(150):
            passage = sentence(draw, 50, 10**6)
            for k, own in enumerate((passage[:40], passage, passage)):
                rows.append((3 * i + k, " ".join(sentence(draw, 40, 10**6) + own + sentence(draw, 40, 10**6))))
        found = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(documents(spark, rows)).collect()}
        assert all((3 * i + 2, 3 * i + 1) in found for i in range(150))

    def test_many_holders_of_a_passage_with_a_part_in_a_smaller_document(self, spark):
        draw = random.Random(22)
        passage = sentence(draw, 60, 10**6)
        rows = [(i, " ".join(sentence(draw, 60, 10**6) + (passage[5:45] if i < 2 else passage) + sentence(draw, 60, 10**6)))
                for i in range(40)]
        got = passages.repeated_passages(documents(spark, rows)).collect()
        assert {r["doc_id"] for r in got if r["stop"] - r["start"] >= 58} >= set(range(3, 40))

    def test_a_passage_at_a_later_place_of_a_repeated_line(self, spark):
        draw = random.Random(23)
        rows = []
        for i in range(20):
            line, passage = sentence(draw, 12, 10**6), sentence(draw, 45, 10**6)
            fill = lambda: sentence(draw, 60, 10**6)
            rows += [(2 * i, " ".join(line + fill() + line + fill() + line + passage)),
                     (2 * i + 1, " ".join(fill() + line + passage))]
        found = {r["doc_id"] for r in passages.repeated_passages(documents(spark, rows)).collect()}
        assert found >= set(range(1, 40, 2))

    def test_windows_of_texts_together_are_those_of_each(self):
        draw = np.random.default_rng(5)
        texts = [draw.integers(1, 2**62, n).astype(np.uint64) for n in (46, 47, 300, 50, 1000)]
        owner = np.repeat(np.arange(5), [len(t) for t in texts])
        start = np.searchsorted(owner, np.arange(5))
        found = passages._compact(np.concatenate(texts), owner, passages.SHINGLES)
        got = {(int(owner[c]), *(int(x - start[owner[c]]) for x in (low, c, high))) for low, c, high in zip(*found)}
        assert got == {(i, *w) for i, t in enumerate(texts) for w in passages.compact_windows(t)}

    def test_empty(self, spark):
        assert passages.repeated_passages(documents(spark, [])).count() == 0
        assert passages.repeated_passages(documents(spark, [(1, "a"), (2, None)])).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


class TestEndEdits:
    """Near passages of 50 to 60 words that are changed near one end or both."""

    @pytest.mark.parametrize("n, edits", [(50, [1]), (50, [4]), (50, [48]), (50, [1, 46]), (52, [1]), (55, [1, 51]), (60, [1, 57])])
    def test_frames(self, n, edits):
        draw = random.Random(n + sum(edits))
        lost = 0
        for _ in range(50):
            word = lambda: "w%d" % draw.randrange(10**9)
            passage = [word() for _ in range(n)]
            changed = [word() if i in edits else w for i, w in enumerate(passage)]
            sides = []
            for own in (passage, changed):
                text = [word() for _ in range(draw.randrange(8, 60))] + own + [word() for _ in range(draw.randrange(8, 60))]
                sides.append(shingles.sequence(shingles.word_hashes(" ".join(text).encode())))
            full = [shingles.sequence(shingles.word_hashes(" ".join(x).encode())) for x in (passage, changed)]
            near = len(set(full[0]) & set(full[1])) / len(set(full[0]) | set(full[1]))
            assert near >= 0.75
            found = passages.shared_passages(*[(x >> np.uint64(32)).astype(np.uint32) for x in sides])
            lost += not found
            assert all(j >= 0.75 and s1 - s0 + 1 >= passages.SHINGLES for s0, s1, _, _, j in found)
        assert lost == 0

    def test_operator(self, spark):
        draw = random.Random(5)
        word = lambda: "w%d" % draw.randrange(10**9)
        rows = []
        for k in range(40):
            passage = [word() for _ in range(52)]
            changed = [word() if i == 1 else w for i, w in enumerate(passage)]
            for j, own in enumerate((passage, changed)):
                rows.append((2 * k + j, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)])))
        got = {r["doc_id"] for r in passages.repeated_passages(documents(spark, rows)).collect()}
        assert len(got) == 40


class TestLeaks:
    def test_common_subsequence(self):
        draw = random.Random(8)
        for _ in range(300):
            a, b = ([draw.choice("abcd") for _ in range(draw.randrange(1, 40))] for _ in range(2))
            assert leaks.common(leaks.masks_of(a), b) == lcs(a, b)

    def test_common_subsequences_of_many_pairs_at_once(self):
        rng = random.Random(5)
        pairs = [([rng.randrange(9) for _ in range(n)], [rng.randrange(9) for _ in range(rng.randrange(90))])
                 for n in (1, 2, 7, 30, 63, 64) for _ in range(20)]
        masks = [leaks.masks_of(a) for a, _ in pairs]
        others = [[x for x in other if x in own] for own, (_, other) in zip(masks, pairs)]
        got = leaks.common_each(
            np.cumsum([0, *map(len, others)]), np.array([own[x] for own, other in zip(masks, others) for x in other], np.uint64),
            np.array([len(a) for a, _ in pairs]))
        assert got.tolist() == [leaks.common(own, other) for own, (_, other) in zip(masks, pairs)]

    def test_items_beyond_the_bits_of_a_number(self, spark, monkeypatch):
        rng = random.Random(6)
        items = {n: [f"w{n}x{rng.randrange(40)}" for _ in range(n)] for n in (30, 64, 65, 140)}
        rest = [f"o{i}" for i in range(500)]
        data = [(k, " ".join(rest[:k * 37] + [w for i, w in enumerate(words) if k < 4 or i % 5])) for k, words in enumerate(
            [*items.values(), *items.values()])]
        got = []
        for together in (leaks.TOGETHER, 20):
            monkeypatch.setattr(leaks, "TOGETHER", together)
            rows = leaks.leaks(documents(spark, data), spark.createDataFrame(
                [(n, " ".join(words)) for n, words in items.items()], "item_id bigint, text string"))
            got.append({(r["doc_id"], r["item_id"]) for r in rows.collect()})
        assert got[0] == got[1] == {(k, n) for k, n in enumerate([*items, *items])}

    def test_planted_items(self, spark):
        draw = random.Random(9)
        items = [(i, " ".join(sentence(draw, n, 3000)) + ". " + " ".join(sentence(draw, 4, 3000)) + ".")
                 for i, n in enumerate([12, 15, 20, 25, 30, 35, 40, 45, 50, 55] * 3)]
        rows, want = [], set()
        for i in range(300):
            w = sentence(draw, draw.randrange(20, 400), 3000)
            if i % 5 == 0:
                item = draw.randrange(len(items))
                copy = words(items[item][1])
                if i % 10 == 0:  # reworded: a fifth of the words replaced, the answer kept
                    copy = edited(draw, copy[:-4], len(copy) // 6) + copy[-4:]
                at = draw.randrange(len(w))
                w[at:at] = copy
                want.add((i, item))
            rows.append((i, " ".join(w)))
        rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "w1 " * 30000)]
        df = documents(spark, rows).withColumns({"term": F.lit(1), "item": F.lit(2), "cosine": F.lit(3)})
        bench = spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(df, bench).collect()}
        assert got == want
        left = {r["doc_id"] for r in leaks.without_leaks(df, bench).collect()}
        assert left == {i for i, _ in rows} - {i for i, _ in want}

    def test_terms_asked_for_never_exceed_those_of_an_accepted_rewording(self):
        stop = [f"s{i}" for i in range(10)]
        items = []
        for i in range(30):
            own = [f"i{i}x{k}" for k in range(14)]
            items.append((i, " ".join(stop + own[:10]) + ". " + " ".join(own[10:]) + "."))
        block = leaks.Block([(i, t.encode()) for i, t in items])
        for words_, answer, own, enough in zip(block.words, block.answers, block.sequences, block.enough):
            kept = words_[:10] + words_[20:]  # function words and answer stay, content words go
            assert leaks.common(leaks.masks_of(words_), kept) >= leaks.REWORDED * len(words_)
            assert kept[-len(answer):] == answer
            assert leaks.common(leaks.masks_of(own), [block.terms[w] for w in kept if w in block.terms]) >= enough

    def test_terms_asked_for_by_length(self):
        block = leaks.Block([(n, " ".join(f"n{n}x{k}" for k in range(n)).encode()) for n in range(5, 120)])
        for words_, enough in zip(block.words, block.enough):
            assert enough / len(words_) >= leaks.REWORDED > (enough - 1) / len(words_)

    def test_blocks_find_the_same(self, spark, monkeypatch):
        draw = random.Random(10)
        items = [(i, " ".join(sentence(draw, 20, 3000))) for i in range(12)]
        df = documents(spark, [(i, " ".join(sentence(draw, 50, 3000)) + " " + items[i][1]) for i in range(12)])
        bench = spark.createDataFrame(items, "item_id long, text string")
        monkeypatch.setattr(leaks, "ITEMS", 5)
        assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(df, bench).collect()} == {(i, i) for i in range(12)}

    def test_randomised_vectors_span_the_leading_space(self, spark):
        draw = np.random.default_rng(11)
        rows = []
        for i in range(200):
            topic = i % 3
            rows.append((i, (np.arange(32)).tolist(), (topic * 8 + draw.integers(0, 8, 32)).tolist()))
        found = spark.createDataFrame(rows, "doc_id long, at array<int>, term array<int>")
        weights = np.ones(24, np.float32)
        vectors = leaks.space(found, weights, rank=6, power=3)
        dense = np.zeros((200, 24))
        for i, _, terms in rows:
            dense[i, np.unique(terms)] = 1
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        exact = np.linalg.svd(dense)[2][:3]
        assert np.linalg.norm(exact @ vectors) ** 2 >= 2.99  # all of the three leading directions

    def test_empty(self, spark):
        bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
        assert leaks.leaks(documents(spark, []), bench).count() == 0
        assert leaks.leaks(documents(spark, [(1, "x")]), bench.limit(0)).count() == 0


class TestPipeline:
    @pytest.fixture(scope="class")
    def staged(self, spark, folder):
        from voxtally.session import cut_lineage

        docs = table(spark, folder, "documents")
        out = [docs]
        for _, stage in corpus_pipeline.STAGES:
            out.append(cut_lineage(stage(spark, out[-1], folder)))
        return [[r.asDict() for r in df.collect()] for df in out]

    def test_stages_against_brute_force(self, staged, spark, folder):
        start, quality, lines, near, leaked, mixed = staged
        assert {r["doc_id"] for r in quality} <= {r["doc_id"] for r in start}
        assert all(len(words(r["text"])) >= 50 for r in quality)
        seen = set()
        for r in sorted(lines, key=lambda r: r["doc_id"]):
            assert r["n_chars"] == len(r["text"])
        for r in sorted(quality, key=lambda r: r["doc_id"]):
            ls = r["text"].split("\n")
            own = {tuple(ls[i : i + 3]) for i in range(len(ls) - 2)}
            if not own & seen:
                assert any(x["doc_id"] == r["doc_id"] for x in lines)
            seen |= own
        comps = brute_components([(r["doc_id"], r["text"]) for r in lines])
        assert {r["doc_id"] for r in near} == set(comps.values())
        bench = [leaks.plain(r["text"].encode()) for r in table(spark, folder, "benchmark").collect()]
        holds = set()
        for r in near:
            w = leaks.plain(r["text"].encode())
            if any(w[i : i + len(b)] == b for b in bench for i, x in enumerate(w) if x == b[0]):
                holds.add(r["doc_id"])
        gone = {r["doc_id"] for r in near} - {r["doc_id"] for r in leaked}
        assert holds <= gone and len(gone) <= len(holds) + 0.05 * len(near)
        assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in leaked}

    def test_columns(self, staged):
        names = list(staged[0][0])
        assert all(list(rows[0]) == names for rows in staged[1:-1])
        assert list(staged[-1][0]) == [*names, "copy"]

    DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, copy long, kept string, n int"

    def run(self, spark, tmp_path, docs, items):
        spark.createDataFrame(docs, self.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return corpus_pipeline.run(spark, str(tmp_path))

    def test_empty_tables(self, spark, tmp_path):
        out = self.run(spark, tmp_path, [], [])
        assert out.count() == 0
        given = table(spark, str(tmp_path), "documents").columns
        assert out.columns == [*[c for c in given if c != "copy"], "copy"]

    def test_nulls_and_clashing_columns(self, spark, tmp_path):
        draw = random.Random(21)
        texts = [" ".join(sentence(draw, 80, 3000)) for _ in range(4)]
        more = ("k", None, "yes", 7)
        docs = [(i, t, "en", f"s{i % 2}", len(t), *more) for i, t in enumerate(texts)]
        docs += [(None, " ".join(sentence(draw, 80, 3000)), None, None, None, None, None, None, None)]
        docs += [(10, None, "en", "s0", 0, *more), (11, "", "en", None, 0, *more), (None, None, None, None, None, *more)]
        docs += [(20, texts[0], "en", "s1", len(texts[0]), *more)]
        out = [r.asDict() for r in self.run(spark, tmp_path, docs, [(1, None), (2, ""), (None, "x y")]).collect()]
        given = {(r[0], r[1]): r for r in docs}
        assert out
        for r in out:
            # No text short, missing or held by a smaller id is left; further columns stay as they were.
            assert r["text"] and r["doc_id"] != 20 and r["copy"] is not None
            key, _, kept, n = given[r["doc_id"], r["text"]][5:]
            assert (r["key"], r["kept"], r["n"]) == (key, kept, n)
