"""URL rules, mixing, line dedup and quality rules on small frames."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from voxtally.llm import line_dedup, mixing, quality, url_filter
from voxtally.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def verdicts(spark, urls, rules, listed=(), **options):
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    out = url_filter.judge(pages(spark, urls), url_filter.rule_table(spark, rules), keys, **options)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr", "allow")]


class TestUrlFilter:
    def test_longest_rule_and_subdomains(self, spark):
        got = verdicts(spark, [
            "http://A.Example.NET/en/1?x", "http://example.net/EN/", "https://b.org/free", "http://xorg/fr",
            "http://net", None, "no url", "", "x://q.net/#a",
        ], RULES)
        assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
        assert got[1] == ("example.net", "/EN/", "net/", "block")
        assert got[2] == ("b.org", "/free", "org/fr", "allow")
        assert got[3] == ("xorg", "/fr", None, "allow")
        assert got[4] == ("net", "", None, "allow")  # an empty path does not start with "/"
        assert got[5] == got[6] == got[7] == ("", "", None, "allow")
        assert got[8] == ("q.net", "/", "net/", "block")

    def test_no_rules_no_list_no_pages(self, spark):
        assert verdicts(spark, ["http://a.b/c"], [])[0] == ("a.b", "/c", None, "allow")
        assert verdicts(spark, [], RULES) == {}

    def test_same_rule_twice_blocks(self, spark):
        assert verdicts(spark, ["http://a.b/c"], [("a.b", "/", "allow"), ("a.b", "/", "block")])[0][3] == "block"

    @pytest.mark.parametrize("max_listed", [10**6, 70])
    def test_membership_is_exact_over_the_universe(self, spark, max_listed):
        draw = random.Random(1)
        urls = [f"http://h{i}.com/{draw.randrange(10**6)}" for i in range(2000)]
        keys = [u.split("://")[1] for u in urls]
        listed = set(draw.sample(keys, 200))
        got = verdicts(spark, urls, [], sorted(listed), max_listed=max_listed)
        assert {keys[i] for i, v in got.items() if v[3] == "block"} == listed

    def test_cascade_levels_alternate(self, spark):
        keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") < 100).alias("listed"))
        cascade = url_filter.build(cut_lineage(keys))
        assert len(cascade) > 1
        wrong = keys.where(url_filter.member(F.col("key"), cascade) != F.col("listed"))
        assert wrong.count() == 0

    def test_clashing_columns(self, spark):
        df = pages(spark, ["http://net/"]).withColumns({"host": F.lit(1), "rule": F.lit("x"), "key": F.lit("y")})
        row = url_filter.judge(df, url_filter.rule_table(spark, RULES), spark.range(0).selectExpr("'' AS key")).first()
        assert (row["host"], row["rule"], row["key"]) == ("net", "net/", "y")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


class TestMixing:
    def test_targets_stop_and_reshare(self, spark):
        sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, source_size long")
        got = {r["source"]: (r["weight"], r["target"]) for r in mixing.targets(sizes).collect()}
        # 1665 words by weight 3:1:2; a stops at 20, then b at 200; the null source has the rest.
        assert got == {"a": (3.0, 20.0), "b": (1.0, 200.0), None: (2.0, 1445.0)}

    def test_order_is_by_code_point(self, spark):
        names = ["b", "B", "é", "a", None, "\U0001F600", "\uFFFD"]
        df = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
        got = [r["source"] for r in mixing.ordinals(df).orderBy("ordinal").collect()]
        assert got == ["B", "a", "b", "é", "\uFFFD", "\U0001F600", None]

    def test_copies_sum_near_target_and_rerun_alike(self, spark):
        df = docs(spark, [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(4000)])
        first = mixing.mix(df).collect()
        again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7)).collect()}
        assert {r["doc_id"]: r["copies"] for r in first} == again
        for source in {r["source"] for r in first}:
            rows = [r for r in first if r["source"] == source]
            taken = sum(r["size"] * r["copies"] for r in rows)
            assert math.isclose(taken, rows[0]["target"], rel_tol=0.1)
        assert max(r["copies"] for r in first) <= 2

    def test_emit_repeats_whole_rows(self, spark):
        df = docs(spark, [(1, "a b", "x"), (2, None, "x"), (2, None, "x"), (None, "c", None)])
        mixed = mixing.mix(df)
        assert mixed.count() == 4
        want = sum(r["copies"] for r in mixed.collect())
        assert mixing.emit(mixed).count() == want

    def test_empty_and_wordless(self, spark):
        assert mixing.mix(docs(spark, [])).count() == 0
        rows = mixing.mix(docs(spark, [(1, None, "a"), (2, " ", "b")])).collect()
        assert all(r["copies"] == 0 and r["target"] == 0 for r in rows)

    def test_clashing_columns(self, spark):
        df = docs(spark, [(1, "a b", "x")]).withColumns({"size": F.lit("big"), "target": F.lit(0), "weight": F.lit(5)})
        row = mixing.mix(df).first()
        assert (row["size"], row["target"], row["weight"]) == (2, 3.0, 5)


def brute_lines(rows):
    seen, out = set(), []
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not any(WORD.search(x) for x in w):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text, len(gone)))
    return out


class TestLineDedup:
    def test_against_brute_force(self, spark):
        draw = random.Random(3)
        rows = [(i, "\n".join(draw.choice("abc  ") for _ in range(draw.randrange(0, 12))), "s") for i in range(200)]
        rows += [(1000, None, "s"), (1001, "", "s"), (1002, "x\ny", "s"), (1003, "q\n" * 5000 + "end", "s")]
        got = [(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.clean(docs(spark, rows)).orderBy("doc_id").collect()]
        assert got == brute_lines(rows)

    def test_repeated_rows_are_one_document(self, spark):
        rows = [(1, "a\nb\nc", "s"), (1, "a\nb\nc", "s"), (2, "a\nb\nc\nd", "s"), (None, "z\nb\nc", "s")]
        got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.clean(docs(spark, rows)).collect())
        assert got == [(0, "z\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]

    def test_empty_table_and_clashing_columns(self, spark):
        assert line_dedup.clean(docs(spark, [])).count() == 0
        df = docs(spark, [(1, "a\nb\nc", "s")]).withColumns({"pos": F.lit(9), "n_lines": F.lit("x"), "h1": F.lit(1)})
        row = line_dedup.clean(df).first()
        assert (row["pos"], row["n_lines"], row["h1"]) == (9, 3, 1)


def brute_quality(text):
    words = WORD.findall(text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeat = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(repeat))


class TestQuality:
    COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def test_counts_against_brute_force(self, spark):
        draw = random.Random(5)
        texts = ["".join(draw.choice("ab é#\n\t\u00a0😀") for _ in range(draw.randrange(0, 120))) for _ in range(150)]
        texts += [None, "", " \n", "a b", "a b c", "a a a a", "x " * 3000]
        df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
        got = {r["doc_id"]: tuple(r[c] for c in self.COLUMNS) for r in quality.rule_stats(df).collect()}
        assert got == {i: brute_quality(t) for i, t in enumerate(texts)}

    def test_bad_host_goes_and_small_host_is_shrunk(self, spark):
        good = " ".join(f"w{i}" for i in range(60))
        rows = [(i, good if i % 10 else "bad", "fine") for i in range(300)]
        rows += [(1000 + i, "bad" if i % 20 else good, "poor") for i in range(300)]
        rows += [(5000, good, "tiny"), (5001, good, None)]
        out = quality.judge(cut_lineage(quality.rule_stats(docs(spark, rows)))).collect()
        kept = {r["doc_id"]: r["kept"] for r in out}
        assert kept[1] and not kept[0] and not kept[1000] and kept[5000] and kept[5001]
        assert len(out) == len(rows)

    def test_empty_and_clashing(self, spark):
        assert quality.judge(quality.rule_stats(docs(spark, []))).count() == 0
        df = docs(spark, [(1, "a", "s"), (1, "a", "s")]).withColumns({"n_docs": F.lit(1), "n_words": F.lit("x"), "failed": F.lit(3)})
        rows = quality.judge(quality.rule_stats(df)).collect()
        assert len(rows) == 2 and rows[0]["n_words"] == 1 and rows[0]["n_docs"] == 1
