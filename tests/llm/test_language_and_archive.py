"""Language identification, personal data and revisits on small frames."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.llm import language, pii, revisits
from voxtally.llm.common import table


class TestLanguage:
    @pytest.fixture(scope="class")
    def model(self, spark, folder):
        return language.fit(table(spark, folder, "documents"), 30)

    ROW = "page_id long, text string, declared string, host string"

    def test_held_out_accuracy(self, spark, model):
        held = table(spark, "/root/testdata/sf0.01", "documents")
        rows = held.select("doc_id", "text", F.lit(None).cast("string").alias("declared"),
                           F.lit(None).cast("string").alias("host"))
        got = language.identify(rows, model, ["doc_id"]).join(held.select("doc_id", F.col("lang").alias("want")), "doc_id")
        assert got.where("lang = want").count() >= 0.98 * held.count()

    def test_evidence_beside_the_text(self, spark, model):
        # A host where German prevails and pages whose markup agrees decide for empty texts.
        de, en = "der die und ist nicht ein zu", "the of and that is was thing"
        rows = [(i, " ".join([de] * 9), "de", "www.a.de") for i in range(80)]
        rows += [(100 + i, " ".join([en] * 9), "en", "b.com") for i in range(80)]
        rows += [(300, "", None, "www.a.de"), (301, None, "de", None), (302, None, None, "x.a.de"), (303, None, "en", "new.org")]
        got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, self.ROW), model, ["page_id"]).collect()}
        assert got[0]["lang"] == "de" and got[100]["lang"] == "en"
        assert got[300]["lang"] == "de" and got[301]["lang"] == "de" and got[302]["lang"] == "de"
        assert got[303]["lang"] == "en" and got[303]["text_lang"] is None
        assert len(got) == len(rows)
        assert all(0 < r["confidence"] <= 1 for r in got.values())

    def test_posterior_equals_brute_force(self, spark, model):
        rng = random.Random(5)
        words = {"de": "der die und ist nicht ein zu".split(), "en": "the of and that is was thing".split()}
        rows = []
        for i in range(60):
            lang = rng.choice(["de", "en"])
            text = rng.choice([None, "", " ".join(rng.choices(words[lang], k=rng.randrange(1, 9)))])
            host = rng.choice([None, "www.a.de", "x.a.de", "b.com", f"own{i}.org", "plain"])
            rows.append((i, text, rng.choice([None, lang, "EN"]), host))
        k, strength = len(model.languages), language.STRENGTH
        logs = [model.likelihoods((text or "").encode()) for _, text, _, _ in rows]

        def softmax(x):
            e = np.exp(x - x.max())
            return e / e.sum()

        p = np.array([softmax(x * language.TEMPER) for x in logs])
        overall = (p.sum(axis=0) + 1) / (len(rows) + k)
        domain = [h and ".".join(h.split(".")[-2:]) for *_, h in rows]
        suffix = [h.split(".")[-1] if h and "." in h else None for *_, h in rows]
        said = [d and d.lower() for _, _, d, _ in rows]

        def others(key, values, i):
            same = [j for j, v in enumerate(values) if v == key and j != i]
            return p[same].sum(axis=0)

        def towards(counts, parent):
            return (counts + strength * parent) / (counts.sum() + strength)

        got = {r["page_id"]: r for r in language.identify(
            spark.createDataFrame(rows, self.ROW), model, ["page_id"]).collect()}
        for i, (_, _, _, host) in enumerate(rows):
            fused = logs[i] * language.TEMPER
            prior = overall
            if host:
                parent = towards(others(domain[i], domain, i), overall)
                prior = towards(others(host, [r[3] for r in rows], i), parent)
            fused = fused + np.log(prior)
            for values in (said, suffix):
                if values[i] is not None:
                    same = [j for j, v in enumerate(values) if v == values[i]]
                    fused = fused + np.log(
                        (p[same].sum(axis=0) + strength * overall) / ((len(same) + strength) * overall))
            want = softmax(fused)
            assert got[i]["confidence"] == pytest.approx(want.max(), rel=1e-6)
            assert got[i]["lang"] == model.languages[int(want.argmax())]

    def test_likelihoods_are_summed_by_trigram(self, model):
        text = b"the thing"
        want = sum(model.logs[t].astype(float) for t in language.trigrams(text))
        assert np.allclose(model.likelihoods(text), want[: len(model.languages)])

    def test_markup(self, spark):
        html = ["<!DOCTYPE html><HTML class=x lang='FR-ca'><p>un<script>var a='<p>';</script>deux<!-- no -->", None, "<html>x", ""]
        rows = spark.createDataFrame([(h,) for h in html], "html string").select(
            language.declared(F.col("html")), language.visible(F.col("html"))).collect()
        assert [r[0] for r in rows] == ["fr", None, None, None]
        assert rows[0][1].split() == ["un", "deux"]

    def test_empty_tables_and_clashes(self, spark, model):
        nothing = spark.createDataFrame([], self.ROW)
        assert language.identify(nothing, model, ["page_id"]).count() == 0
        none = language.fit(spark.createDataFrame([], "doc_id long, lang string, text string"))
        row = spark.createDataFrame([(1, "a", None, None)] * 2, self.ROW).withColumns(
            {"lang": F.lit("zz"), "domain": F.lit(1), "likelihoods": F.lit(2)})
        assert [r["lang"] for r in language.identify(row, none, ["page_id"]).collect()] == [None, None]
        assert language.identify(row, model, ["page_id"]).count() == 2


def brute_base(text):
    """The contract's patterns as they stand."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class TestPii:
    def test_base_against_the_patterns(self):
        draw = random.Random(7)
        for _ in range(4000):
            text = "".join(draw.choice("ab1234.@+- ()_é\n") for _ in range(draw.randrange(60)))
            assert pii.base_spans(text) == brute_base(text), text
        for text in ("4111 1111-11111111", "1.2.3.4.5.6.7.8", "0.0.0.256 010.0.0.255", "a@b.com_x@d.org", "@a.b a@.b a@b"):
            assert pii.base_spans(text) == brute_base(text), text

    def test_long_runs_stay_linear(self):
        for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000):
            assert isinstance(pii.base_spans(text), list)

    def test_decoder_is_the_best_of_all_segmentations(self):
        draw = np.random.default_rng(1)
        weights = draw.normal(size=(len(pii.KINDS), len(pii._FEATURES)))
        text = "12 a@b.c +1 (555) 4111"
        run = pii.stretches(text)[0]
        scores = pii._scores(pii._segments(text, run), weights)

        def every(i):
            if i == len(run):
                yield 0.0
                return
            yield from every(i + 1)
            for j in range(i + 1, min(len(run), i + pii.MAX_TOKENS) + 1):
                for rest in every(j):
                    yield from (s + rest for s in scores[i, j])

        totals = np.array(list(every(0)))
        forward, backward = pii._sums(scores, len(run))
        assert np.isclose(np.logaddexp.reduce(totals), forward[-1]) and np.isclose(forward[-1], backward[0])

    def test_field_learns_and_adds_without_touching_base(self, spark, folder):
        documents = table(spark, "/root/testdata/sf0.1", "documents")
        weights = pii.train(pii.sample(documents, 300))
        held = [r["text"] for r in documents.where("doc_id % 100 = 3").collect()]
        found = base = 0
        for text in held:
            want = pii.base_spans(text)
            got = pii.field_spans(text, weights)
            base += len(want)
            found += len(set(want) & set(got))
            spans = pii.all_spans(text, weights)
            assert [s[:3] for s in spans if s[3]] == want
            added = [s for s in spans if not s[3]]
            assert not any(a[1] < e and s < a[2] for a in added for _, s, e in want)
        assert base > 0 and found >= 0.9 * base

    def test_rows(self, spark):
        df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x a@b.co"), (3, "é 10.0.0.1")], "doc_id long, text string")
        df = df.withColumns({"spans": F.lit(1), "kind": F.lit("k")})
        rows = pii.find(df, np.zeros((4, len(pii._FEATURES)))).collect()
        got = sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in rows)
        assert got == [(0, [("email", 2, 8, True)]), (1, []), (1, []), (2, []), (3, [("ip", 2, 10, True)])]
        assert pii.find(df.limit(0)).count() == 0

    def test_untrained_field_adds_nothing(self):
        assert pii.field_spans("call 555 1234 5678", pii.train([])) == []


CAPTURE = "id long, url string, at long, full boolean, etag string, last_modified string, digest string, headers map<string,string>"


def resolved(spark, rows):
    got = revisits.resolve(spark.createDataFrame(rows, CAPTURE))
    return {r["id"]: (r["status"], r["response_id"], r["digest"]) for r in got.collect()}


class TestRevisits:
    def test_latest_earlier_response_and_validators(self, spark):
        u = "http://A.com/x/"
        rows = [
            (1, u, 10, True, '"a"', "d1", "h1", {"etag": '"a"', "content-length": "5", "date": "1"}),
            (2, "https://www.a.com/x?utm_source=f#t", 20, True, '"b"', "d2", "h2", {}),
            (3, u, 15, False, 'W/"a"', None, None, {"date": "2", "content-length": "0"}),
            (4, u, 25, False, '"a"', "d2", None, None),
            (5, u, 25, False, None, "d2", None, None),
            (6, u, 25, False, None, None, None, None),
            (7, u, 10, False, '"a"', None, None, None),
            (8, "http://other/", 99, False, '"a"', None, None, None),
            (9, None, 99, False, '"a"', None, None, None),
            (10, u, None, False, '"a"', None, None, None),
        ]
        got = resolved(spark, rows)
        assert got[3] == ("resolved", 1, "h1")
        assert got[4] == ("validator mismatch", 2, None)
        assert got[5] == ("resolved", 2, "h2")
        assert got[6] == ("no validator", 2, None)
        assert got[7] == got[8] == got[9] == got[10] == ("no response", None, None)
        merged = {r["id"]: r["headers"] for r in revisits.resolve(spark.createDataFrame(rows, CAPTURE)).collect()}
        assert merged[3] == {"etag": '"a"', "content-length": "5", "date": "2"}

    def test_against_brute_force_with_a_hot_address(self, spark):
        draw = random.Random(2)
        rows = []
        for i in range(3000):
            url = "http://hot/" if draw.random() < 0.5 else f"http://h{draw.randrange(40)}/"
            rows.append((i, url, draw.randrange(2000), draw.random() < 0.3, None, None, str(i), None))
        # Many small ranges, so that the hot address crosses borders.
        df = spark.createDataFrame(rows, CAPTURE)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r["id"]: r["response_id"] for r in revisits.resolve(df).collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        for i, url, at, full, *_ in rows:
            if not full:
                want = max(((a, j) for j, u, a, f, *_ in rows if f and u == url and a < at), default=(0, None))[1]
                assert got[i] == want

    def test_empty_repeated_and_clashing(self, spark):
        df = spark.createDataFrame([(1, "http://a/", 1, True, '"a"', None, "h", None), (2, "http://a/", 2, False, '"a"', None, None, None),
                                    (2, "http://a/", 2, False, '"a"', None, None, None)], CAPTURE)
        rows = revisits.resolve(df.withColumns({"key": F.lit(1), "found": F.lit(2), "answer": F.lit(3)})).collect()
        assert [r["digest"] for r in rows] == ["h", "h"]
        assert revisits.resolve(df.limit(0)).count() == 0
        assert revisits.resolve(df.where("full")).count() == 0
