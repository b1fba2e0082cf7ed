"""Single operators on small fixtures: nulls, empties, ties and the rules that tables do not show."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spandrel.functions import receipts as R
from spandrel.functions import text as TX
from spandrel.operators import captions, chunking, evaluation, geometry, gram_index, layout, long_chunks, quantiles, receipts, retrieval


def one(spark, value, *args):
    """The value of a column over a single row."""
    return spark.range(1).select(value.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("2024-05-12", "2024-05-12"), ("113年5月12日", "2024-05-12"), ("中華民國113年05月12日", "2024-05-12"), ("12/05/2024", "2024-05-12"), ("20240512", "2024-05-12"), ("1130512", "2024-05-12"), ("2024-02-30", None), ("1989-01-01", None), ("", None), (None, None), ("no date", None)],
)
def test_dates(spark, raw, iso):
    assert one(spark, R.date(F.lit(raw).cast("string"))) == iso


@pytest.mark.parametrize(("raw", "value"), [("NT$1,234", 1234.0), ("RM 7.30", 7.3), ("-5", -5.0), ("95元", 95.0), ("about 5", None), ("", None), (None, None)])
def test_amounts(spark, raw, value):
    assert one(spark, R.amount(F.lit(raw).cast("string"))) == value


def test_tax_ids(spark):
    assert [one(spark, R.tax_id_valid(F.lit(x).cast("string"))) for x in ("22555003", "12345678", "1234567", None)] == [True, False, False, False]


def test_fuzzy_scores(spark):
    pairs = [("abc", "abc", 1.0), (None, None, 1.0), ("a", None, 0.0), ("", "", 1.0), ("abcd", "abcx", 0.75), ("全家", "全聯", 0.5)]
    for a, b, want in pairs:
        assert one(spark, R.fuzzy(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


def test_text_forms(spark):
    assert one(spark, TX.normalize_text(F.lit("　ａｂ  c "))) == "AB C"
    assert one(spark, TX.ngrams(F.lit("a B"))) == ["ab"] and one(spark, TX.ngrams(F.lit("x"))) == ["x"] and one(spark, TX.ngrams(F.lit(" "))) == []
    assert one(spark, TX.sentences(F.lit("甲。乙! 丙\n\n丁"))) == ["甲。", "乙!", "丙", "丁"]
    kinds = {"表 1 x": "caption", "註: y": "footnote", "- z": "list", "第一章 總則": "heading", "plain": "paragraph", "": "paragraph"}
    assert {t: one(spark, TX.classify(F.lit(t))) for t in kinds} == kinds


def items(*pairs):
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).cast("double").alias("amount")) for n, a in pairs)) if pairs else F.array().cast("array<struct<name:string,amount:double>>")


def test_item_alignment(spark):
    got = one(spark, receipts.align_items(items(("apple", 1), ("pear", 2)), items(("pear", 2), ("aple", 3))))
    assert [(m.gt_idx, m.pred_idx, m.amount_exact) for m in got] == [(1, 0, True), (0, 1, False)]
    got = one(spark, receipts.align_items(items(("tea", 1)), items(("quite different", 1))))
    assert [(m.gt_idx, m.pred_idx) for m in got] == [(0, None), (None, 0)]
    assert one(spark, receipts.align_items(items(), items())) == []


def test_fixed_chunks(spark):
    texts = lambda *n: F.array(*(F.lit("x" * k) for k in n))
    spans = lambda c: [(s.first, s.last) for s in one(spark, c)]
    assert spans(chunking.fixed_chunks(texts(10, 900, 20), 100, 12)) == [(0, 0), (0, 1), (1, 2)]
    assert spans(chunking.fixed_chunks(texts(10, 10, 10), 22, 0)) == [(0, 1), (2, 2)]
    assert spans(chunking.fixed_chunks(F.array().cast("array<string>"))) == []
    with pytest.raises(ValueError):
        chunking.fixed_chunks(texts(1), 100, 100)


def test_structure_chunks(spark):
    rows = [("heading", "A", 1), ("paragraph", "b", 1), ("table", "t", 1), ("figure", "f", 1), ("caption", "c", 1), ("footnote", "n", 1), ("table", "u", 2), ("paragraph", "z", 2)]
    els = F.array(*(F.struct(F.lit(k).alias("type"), F.lit(t).alias("text"), F.lit(p).alias("page"), F.lit("g" if k == "table" else None).cast("string").alias("continuity"), F.lit(t == "z").alias("shadowed")) for k, t, p in rows))
    got = one(spark, chunking.structure_chunks(els))
    assert [(x.chunk, x.kind) for x in got] == [(0, "text"), (0, "text"), (1, "table"), (2, "figure-caption"), (2, "figure-caption"), (2, "text"), (1, "cross-page-table"), (-1, None)]


def test_sections(spark):
    els = F.array(*(F.struct(F.lit(level).cast("int").alias("level"), F.lit(t).alias("text"), F.lit(p).alias("page")) for level, t, p in [(1, "A", 1), (None, "x", 1), (2, "B", 1), (None, "y", 1), (1, "C", 1), (None, "z", 2)]))
    assert one(spark, chunking.level_sections(els)) == [[], ["A"], ["A"], ["A", "B"], [], []]


def test_retrieval_fills_up_with_zeros_and_breaks_ties(spark):
    chunks = spark.createDataFrame([(2, 0, "zzzz"), (1, 0, "abcd"), (1, 1, "abcd"), (3, 0, ""), (4, 0, None)], "doc_id long, chunk_idx int, text string")
    questions = spark.createDataFrame([(7, "abcd"), (8, "q"), (9, None)], "item_id long, text string")
    got = {}
    for r in retrieval.top_chunks(chunks.repartition(3), questions, k=4).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.chunk_idx, round(r.score, 3)))
    assert sorted(got[7]) == [(1, 1, 0, 1.0), (2, 1, 1, 1.0), (3, 2, 0, 0.0), (4, 3, 0, 0.0)]
    assert [x[3] for x in got[8]] == [0.0] * 4 and len(got[9]) == 4
    assert retrieval.top_chunks(chunks.filter("false"), questions).collect() == []
    with pytest.raises(ValueError):
        retrieval.Windows(100, 100)


def plain_cosine(a, b):
    grams = lambda t: collections.Counter([t] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)])
    x, y = (grams("".join((t or "").lower().split())) for t in (a, b))
    norm = lambda c: math.sqrt(sum(n * n for n in c.values()))
    return sum(n * y[g] for g, n in x.items()) / (norm(x) * norm(y)) if x and y else 0.0


def test_search_equals_scores_of_all_pairs(spark, monkeypatch):
    """Blocks of a few chunks and questions each, so that many meet and most are left out by their bounds."""
    for name, n in (("CHUNKS", 7), ("SLICE", 5)):
        monkeypatch.setattr(gram_index, name, n)
    r = random.Random(3)
    text = lambda: "".join(r.choice("abcdeé 你好") for _ in range(r.choice([0, 1, 5, 40])))
    chunks = [(r.randrange(40), i, r.choice([text(), "abcab", None])) for i in range(150)]
    asked = [(i, r.choice([text(), "abc", None])) for i in range(60)]
    c = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, text string").repartition(5)
    q = spark.createDataFrame(asked, "item_id long, text string").repartition(3)
    stated = gram_index.asked(q, size=4)
    monkeypatch.setattr(gram_index, "asked", lambda *_: stated)
    got = collections.defaultdict(list)
    for x in retrieval.top_chunks(c, q, k=6).collect():
        got[x.item_id].append((x["rank"], x.doc_id, x.chunk_idx, x.score))
    for i, t in asked:
        want = sorted((-round(plain_cosine(t, u), 9), d, n) for d, n, u in chunks)[:6]
        assert [(d, n, round(s, 9)) for _, d, n, s in sorted(got[i])] == [(d, n, -s) for s, d, n in want], t


def plain_windowed(q, text, w):
    grams = lambda t: collections.Counter([t] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)])
    cover = lambda t: sum((grams("".join(q.split())) & grams("".join(t.split()))).values()) / max(1, sum(grams("".join(q.split())).values()))
    x = text.strip()
    parts = [x] if len(x) <= w.size else [x[i : i + w.size] for i in range(0, len(x), w.size - w.overlap)]
    return w.whole * plain_cosine(q, text) + (1 - w.whole) * max((1 - w.coverage) * plain_cosine(q, t) + w.coverage * cover(t) for t in parts), cover(text)


def test_windowed_and_covering_scores_equal_those_of_all_pairs(spark, monkeypatch):
    """Counts of many sizes in questions and texts; one question repeats a gram a hundred thousand times."""
    for name, n in (("CHUNKS", 6), ("SLICE", 4)):
        monkeypatch.setattr(gram_index, name, n)
    r, w = random.Random(5), retrieval.Windows(12, 4)
    text = lambda: "".join(r.choice("aaab é") * r.choice([1, 1, 9]) for _ in range(r.choice([0, 1, 8, 20])))
    chunks, asked = [(i % 7, i, text()) for i in range(60)], [*((i, text()) for i in range(20)), (20, "a" * 100_000 + "b")]
    c, q = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    for kind, at in (({"windows": w}, 0), ({"score": "coverage"}, 1)):
        got = collections.defaultdict(list)
        for x in retrieval.top_chunks(c, q, k=4, **kind).collect():
            got[x.item_id].append((x["rank"], x.doc_id, x.chunk_idx, round(x.score, 9)))
        for i, t in asked:
            want = sorted((-round(plain_windowed(t, u, w)[at], 9), d, n) for d, n, u in chunks)[:4]
            assert [x[1:] for x in sorted(got[i])] == [(d, n, -s) for s, d, n in want], (kind, t[:50])


def test_an_index_is_no_larger_than_twice_its_texts(spark):
    r = random.Random(7)
    chunks = [(i, 0, "".join(r.choice("abcdefghij klmnopqrs") for _ in range(800))) for i in range(200)]
    made = gram_index.index(spark.createDataFrame(chunks, "doc_id long, chunk_idx int, text string").repartition(1))
    fields = [x.strip().split(" ")[0] for x in gram_index.POSTINGS.split(",")]
    assert made.select(sum(F.octet_length(f) for f in fields).alias("n")).agg(F.sum("n")).first()[0] < 2 * 200 * 800


def test_evidence_is_found_once_for_all_rankers(spark, monkeypatch):
    from spandrel.plans import document_queries as q

    asked, real = [], retrieval.evidence_in
    monkeypatch.setattr(q.R, "evidence_in", lambda *a: asked.append(1) or real(*a))
    q.g3_promotion_gate(spark, "/root/testdata/sf0.001")
    assert asked == [1]


def test_questions_never_pass_the_driver(spark):
    """A hundred thousand questions are planned without a job, and answered."""
    ids = spark.range(100_000).select(F.col("id").alias("item_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("text"))
    chunks = spark.createDataFrame([(1, 0, "q77777"), (2, 0, "zz")], "doc_id long, chunk_idx int, text string")
    top = retrieval.top_chunks(chunks, ids, k=1)
    assert top.count() == 100_000
    assert top.filter("item_id = 77777").collect()[0].score == 1.0


def test_evidence_is_met_by_one_chunk(spark):
    r = random.Random(6)
    words = ["alpha", "Beta", "g a m", "12%", "δ元", "，"]
    chunks = [(d, i, " ".join(r.sample(words, r.randrange(5))), sorted(r.sample([1, 2, 3], r.randrange(3)))) for d in range(9) for i in range(4)] + [(9, 0, None, None)]
    maybe = lambda x: r.choice([None, None, x])
    evidence = [(q, e, maybe(r.randrange(9)), maybe(r.randrange(4)), maybe(r.sample([1, 2, 3], r.randrange(3))), r.choice([None, [], r.sample(words, 1), r.sample(words, 2), ["alpha", "alpha", "missing"]])) for q in range(40) for e in range(2)]
    form = lambda t: re.sub(r"[\s,，。．%％元]", "", t or "").lower()
    want = []
    for q, e, document, page, pages, terms in evidence:
        for d, i, text, on in chunks:
            on = on or []
            if document in (None, d) and (not page or page in on) and set(pages or ()) <= set(on) and all(form(t) in form(text) for t in terms or ()):
                want.append((q, e, d, i))
    c = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, text string, pages array<int>").repartition(3)
    ev = spark.createDataFrame(evidence, "item_id long, evidence int, document long, page int, pages array<int>, terms array<string>")
    assert sorted(map(tuple, retrieval.evidence_in(c, ev.repartition(4)).collect())) == sorted(want) and want
    assert retrieval.evidence_in(c, ev.filter("false")).collect() == [] == retrieval.evidence_in(c.filter("false"), ev).collect()


def test_results_of_questions(spark):
    chunks = spark.createDataFrame([(5, 0, "the total is 7 units"), (6, 0, "seven"), (7, 0, "total is 9"), (8, 0, "and 2")], "doc_id long, chunk_idx int, text string")
    top = spark.createDataFrame([(q, 5, 0, 1) for q in range(1, 9)] + [(q, 6, 0, 2) for q in range(1, 9)], "item_id long, doc_id long, chunk_idx int, rank int")
    found = spark.createDataFrame([(1, 0, 5, 0), (1, 1, 6, 0), (2, 0, 9, 9), (4, 0, 6, 0), (5, 0, 6, 0), (7, 0, 6, 0)], "item_id long, evidence int, doc_id long, chunk_idx int")
    total = r"total is (?P<answer>\d+)"
    q = spark.createDataFrame(
        [(1, 2, "all", False, ["7"], None, total), (2, 1, None, False, ["7"], "first", total), (3, 1, "any", None, ["8"], "first", total), (4, 1, "any", False, ["7"], "first", total), (5, 1, "any", False, ["7"], "sum", r"\d+"), (6, 0, "all", True, None, None, total), (7, 1, "all", False, ["x"], None, "none"), (8, 0, "any", False, None, None, None)],
        "item_id long, n_evidence int, mode string, unanswerable boolean, accepted array<string>, operation string, pattern string",
    )
    answered = retrieval.answers(top, chunks, q)
    rows = {r.item_id: tuple(r)[1:] for r in retrieval.question_results(top, found, chunks, q, answered).collect()}
    assert rows[1] == ("7", 1.0, 0.5, True, True, None)  # the last piece of evidence comes second
    assert rows[2] == ("7", 0.0, 0.0, True, False, None)  # right, though its evidence was not retrieved
    assert rows[3] == ("7", 0.0, 0.0, False, False, "parsing")
    assert rows[4] == ("7", 1.0, 0.5, True, False, None)  # the chunk with evidence does not hold the answer
    assert rows[5] == ("7", 1.0, 0.5, True, True, None)  # a sum need not be written anywhere
    assert rows[6] == (None, 1.0, 1.0, True, True, None)
    assert rows[7] == (None, 1.0, 0.5, False, False, "generation") and rows[8][3:] == (False, False, "parsing")
    bad = q.withColumn("mode", F.lit("most"))
    with pytest.raises(Exception, match="no such evidence mode"):
        retrieval.question_results(top, found, chunks, bad, answered).collect()


def test_extractive_answers(spark):
    text = F.lit("total 1,000\nTotal 374150\ntotal 374150")
    ask = lambda op, p=r"total ([\d,]+)": one(spark, retrieval.extractive_answer(text, F.lit(p).cast("string"), F.lit(op), 1))
    assert ask("first") == "1,000" and ask("unique_join") == "1,000、374150" and ask("sum") == "375150"
    assert ask("first", "none (x)") is None and ask("first", None) is None
    named = lambda p: one(spark, retrieval.extractive_answer(text, F.lit(p), F.lit("first")))
    assert named(r"(to)(?:tal) (?P<answer>[\d,]+)") == "1,000" and named(r"TOTAL \d") == "total 1" and named(r" 1,000\s") == "1,000"


def test_parser_cases(spark):
    text, terms = F.lit("Alpha beta\nGAMMA"), lambda *t: F.array(*map(F.lit, t))
    assert one(spark, evaluation.completeness(text, terms("alpha b", "delta"))) == 0.5
    assert one(spark, evaluation.reading_order(text, terms("alpha", "beta", "gamma"))) == 1.0
    assert one(spark, evaluation.reading_order(text, terms("gamma", "alpha"))) == 0.0 and one(spark, evaluation.reading_order(text, terms("x"))) == 1.0
    assert one(spark, evaluation.contamination(F.lit("a a a a"), F.lit("a"), F.lit(2))) == 0.5
    els = F.array(F.struct(F.lit("footnote").alias("type"), F.lit("note").alias("text"), F.lit(1).alias("page"), F.lit(None).cast("double").alias("x0")), F.struct(F.lit("figure").alias("type"), F.lit("pic").alias("text"), F.lit(2).alias("page"), F.lit(1.0).alias("x0")))
    assert one(spark, evaluation.footnote_anchor(F.lit("anchor note"), els, F.lit("anchor"), F.lit("note"))) == 1.0
    assert one(spark, evaluation.continuity(els, F.lit("note"), F.lit("pic"))) == 1.0
    assert one(spark, evaluation.visual(els, F.lit("figure"), F.lit(2), F.lit(True))) == 0.5


def test_promotion(spark):
    row = lambda *v: spark.createDataFrame([v], "base_a double, cand_a double, base_questions long, cand_questions long")
    word = lambda df, **k: evaluation.promotion(df, ("a",), 10, **k).first()["recommendation"]
    assert word(row(0.5, 0.6, 10, 10)) == "GO" and word(row(0.5, 0.5, 10, 10)) == "NO-GO" and word(row(0.5, 0.6, 9, 9)) == "NO-GO"
    assert word(row(0.5, None, 10, None)) == "PENDING" and word(row(0.5, 0.6, 10, 10), eligible=False) == "NOT-PROMOTION-EVIDENCE"


def test_tables(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit(None).cast("string")), F.array(F.lit(" c  d ")))
    assert one(spark, geometry.table_markdown(geometry.clean_rows(rows))) == "| a｜b |  |\n| --- | --- |\n| c d |  |"
    spans = F.array(*(F.struct(F.lit(float(a)).alias("y0"), F.lit(float(b)).alias("y1")) for a, b in [(0, 10), (10, 20), (20, 100)]))
    assert one(spark, geometry.trimmed_rows(spans, F.array(F.lit(2), F.lit(2), F.lit(1)), F.lit(50.0))) == 2
    assert one(spark, geometry.trimmed_rows(spans, F.array(F.lit(2), F.lit(2), F.lit(2)), F.lit(50.0))) == 3


def test_line_grouping(spark):
    boxes = F.array(*(F.struct(F.lit(float(y)).alias("yc"), F.lit(10.0).alias("h"), F.lit(float(x)).alias("x"), F.lit(i).cast("long").alias("id")) for i, (y, x) in enumerate([(12, 50), (10, 1), (40, 1), (44, 9)])))
    assert [(r.line, r.id) for r in one(spark, layout.line_numbers(boxes))] == [(0, 1), (0, 0), (1, 2), (1, 3)]


def test_lines_of_many_rows_at_once(spark):
    """The fold of all rows together: rows of no box, one and several, nulls, boxes of equal centres, and places for lines."""
    box = lambda yc, h, x, i: (yc, h, x, i)
    rows = [(0, []), (1, [box(10.0, 10.0, 5.0, 1)]), (2, [box(30.0, 10.0, 0.0, 4), box(10.0, 10.0, 9.0, 1), box(12.0, 10.0, 1.0, 2), box(17.5, 10.0, 0.0, 3)]), (3, None), (4, [box(None, 5.0, 1.0, 1), box(3.0, None, 1.0, 2), box(7.9, 2.0, None, 3)])]
    df = spark.createDataFrame(rows, "k int, b array<struct<yc:double,h:double,x:double,id:long>>").repartition(1)
    got = {r.k: r for r in df.select("k", layout.line_numbers(F.col("b")).alias("n"), layout.lines_of(F.col("b")).alias("l")).collect()}
    numbers = {k: None if r.n is None else [(x.line, x.id) for x in r.n] for k, r in got.items()}
    assert numbers == {0: [], 1: [(0, 1)], 2: [(0, 2), (0, 1), (1, 3), (2, 4)], 3: None, 4: [(0, 1), (1, 3), (1, 2)]}
    assert {k: r.l for k, r in got.items()} == {0: [], 1: [[0]], 2: [[2, 1], [3], [0]], 3: None, 4: [[0], [2, 1]]}


def test_half_width_of_arrays_equals_that_of_texts(spark):
    from spandrel.functions import text as TX

    rows = [(0, ["ＡＢ", "plain", None, "ｶﾞ①"]), (1, []), (2, None), (3, ["x", "ＡＢ"])]
    df = spark.createDataFrame(rows, "k int, t array<string>").repartition(1)
    each = {r.k: r.h for r in df.select("k", TX.to_halfwidth_each(F.col("t")).alias("h")).collect()}
    one_ = {}
    for r in df.select("k", F.posexplode("t").alias("i", "t")).select("k", "i", TX.to_halfwidth("t").alias("h")).orderBy("k", "i").collect():
        one_.setdefault(r.k, []).append(r.h)
    assert each == {0: one_[0], 1: [], 2: None, 3: one_[3]}



def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {r.violation: r.n for r in evaluation.set_difference(a, b, ["k"]).collect()} == {"only_left": 1, "only_right": 1, "repeated": 1}
    assert {r.side: r.n for r in evaluation.same_rows(a, b).collect()} == {"published only": 2, "recomputed only": 1}
    assert evaluation.same_rows(a, a).collect() == []


@pytest.mark.parametrize("few", [40, 100_000])
def test_quantiles_of_large_groups(spark, few):
    """Few values a range and a row, so that ranks are refined over several rounds; ties, infinities, nulls, null groups."""
    r = random.Random(7)
    far = [1e300, -1e300, float("inf"), -float("inf")]
    kinds = {"one": lambda: 5.0, "flat": r.random, "steep": lambda: 10 ** r.uniform(-250, 250) * r.choice([-1, 1]), "tied": lambda: float(r.randrange(3)), None: lambda: r.choice([*far[:2], r.gauss(0, 1)])}
    rows = [(k, None if r.random() < 0.05 else f()) for k, f in kinds.items() for _ in range(400)] + [("few", 2.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = {"a": 0.0, "p50": 0.5, "p95": 0.95, "b": 1.0}
    got = {x.g: x for x in quantiles.quantiles(frame, ["g"], "v", wanted, few, bins=64, row=16).collect()}
    assert set(got) == {*kinds, "few", "none"}
    for g, x in got.items():
        own = sorted(v for k, v in rows if k == g and v is not None)
        for name, p in wanted.items():
            if not own:
                assert x[name] is None
                continue
            at = (len(own) - 1) * p
            a, b = own[math.floor(at)], own[math.ceil(at)]
            assert math.isclose(x[name], a if a == b else a + (b - a) * (at - math.floor(at)), rel_tol=1e-12), (g, name)
    assert quantiles.quantiles(frame.filter("false"), ["g"], "v", wanted, few).collect() == []


@pytest.mark.parametrize(("size", "overlap", "segment"), [(30, 8, 30), (30, 0, 64), (30, 29, 33)])
def test_chunks_over_segments_equal_the_fold(spark, size, overlap, segment):
    r = random.Random(size + overlap)
    lengths = [lambda: 0, lambda: r.randrange(4), lambda: r.choice([0, 5, 29, 30, 31, 500]), lambda: r.randrange(12)]
    docs = [(i, [None if r.random() < 0.05 else "x" * f() for _ in range(n)]) for i, (n, f) in enumerate((n, f) for n in (0, 1, 29, 64, 330) for f in lengths)] + [(None, ["a", "b"])]
    frame = spark.createDataFrame(docs, "doc_id long, texts array<string>").repartition(3)
    want = sorted(((x.doc_id, k, s.first, s.last) for x in frame.select("doc_id", chunking.fixed_chunks(F.col("texts"), size, overlap).alias("spans")).collect() for k, s in enumerate(x.spans)), key=repr)
    rows = frame.select("doc_id", F.posexplode("texts").alias("ord", "text"), F.lit("clash").alias("key"))
    got = sorted(map(tuple, long_chunks.fixed_chunks(rows, size=size, overlap=overlap, segment=segment).collect()), key=repr)
    assert got == want
    assert long_chunks.fixed_chunks(rows.filter("false"), size=size, overlap=overlap, segment=segment).collect() == []


def test_table_cases(spark):
    cases = spark.createDataFrame(
        [(1, 1, None, "Total  A", None, 0.0, 0.0, 1.0, 1.0), (2, 1, [2], "zz", ["x", "y", "q"], 0.0, 0.0, 1.0, 1.0), (3, 1, [], None, ["x", None], 0.0, 0.0, 1.0, 1.0), (4, 7, None, "", None, 0.0, 0.0, 1.0, 1.0), (5, 2, [], "", [], 0.0, 0.0, 1.0, 1.0), (6, 1, [1, 1], "cap", [], 0.0, 0.0, 1.0, 1.0)],
        "case_id int, doc int, pages array<int>, anchor string, cells array<string>, bx0 double, by0 double, bx1 double, by1 double",
    )
    tables = spark.createDataFrame(
        [(1, 1, "totala", None, None, False, 0.0, 0.0, 0.5, 1.0), (1, 1, "x y q total a", None, None, True, 0.0, 0.0, 1.0, 1.0), (1, 2, "x", "Y", "the Cap", None, 0.0, 0.0, 0.25, 1.0), (1, 1, "w", None, "a CAP", None, None, None, None, None)],
        "doc int, page int, text string, markdown string, caption string, shadowed boolean, x0 double, y0 double, x1 double, y1 double",
    )
    documents = spark.createDataFrame([(1,), (2,), (2,)], "doc int")
    got = {r.case_id: (r.score, r.candidates) for r in evaluation.table_cases(cases, tables, documents).collect()}
    assert got == {1: (0.5, 1), 2: (0.25, 1), 3: (0.0, 0), 5: (0.0, 0), 6: (0.0, 0)}
    assert evaluation.case_summary(evaluation.table_cases(cases, tables, documents)).first()[:] == (5, 0.15)
    assert evaluation.case_summary(evaluation.table_cases(cases.filter("false"), tables, documents)).first()[:] == (0, None)


def test_one_index_of_variants_equals_separate_ones(spark, monkeypatch):
    """Every variant of a captioned corpus against a search of its own; ties, captions without a page, and no captions."""
    monkeypatch.setattr(gram_index, "CHUNKS", 3)
    chunks = [(d, i, t, [i + 1]) for d in range(4) for i, t in enumerate(["profit by year", "same text", "nothing"])]
    told = [(d, d % 3 + 1, 0, "a chart", "profit 2024 up" if d % 2 else "same text", [1, d]) for d in range(4)] + [(1, 9, 1, "lost", "lost", [2])]
    c = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, text string, pages array<int>").repartition(2)
    cap = spark.createDataFrame(told, "doc_id long, page int, chunk int, generic string, structured string, question_ids array<int>")
    q = spark.createDataFrame([(1, "profit 2024"), (2, "same text"), (3, None), (7, "no caption aims here")], "item_id int, text string")
    got = collections.defaultdict(list)
    for x in captions.ablation(c, cap, q, k=6).collect():
        got[x["mode"], x.item_id].append((x["rank"], x.doc_id, x.chunk_idx, x.is_caption, round(x.score, 9)))
    assert {i for _, i in got} == {1, 2, 3} and {m for m, _ in got} == set(captions.MODES)
    for mode, bits in zip(captions.MODES, (None, "generic", "structured", "structured"), strict=True):
        rows = [(d, i, False, t) for d, i, t, _ in chunks] + [(x[0], x[2], True, x[3 if bits == "generic" else 4]) for x in told if bits and x[1] < 4]
        for item, text in ((1, "profit 2024"), (2, "same text"), (3, None)):
            want = sorted((-round(plain_cosine(text, t), 9), caption, d, i) for d, i, caption, t in rows)[:6]
            assert sorted(got[mode, item]) == [(n, d, i, caption, -s) for n, (s, caption, d, i) in enumerate(want, 1)], (mode, item)
    assert captions.ablation(c, cap.filter("false"), q).collect() == []


def test_overlaps_take_one_pair_of_texts_out_of_a_batch(spark):
    """A batch of thirty megabytes of texts is never a batch of Python texts."""
    import tracemalloc

    import pyarrow as pa

    one, half = "añ你😀" * 250, "añ你😀" * 125
    a, b = pa.array([one] * 5000 + [None]), pa.array([half] * 5000 + ["x"])
    tracemalloc.start()
    got = evaluation.multiset_overlap.func(a, b)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert got[0].as_py() == {"shared": 500, "a": 1000, "b": 500} and got[5000].as_py() == {"shared": 0, "a": 0, "b": 1}
    rows = spark.createDataFrame([(1, "a b b\u3000c", "bb b"), (2, "", None), (3, " ", "x")], "k int, a string, b string")
    recall, precision = evaluation.overlap_rates(F.col("a"), F.col("b"))
    assert sorted(rows.select("k", recall, precision).collect()) == [(1, 0.5, 0.666667), (2, 1.0, 1.0), (3, 1.0, 0.0)]


def test_cases_are_scored_on_texts_made_ready_once(spark):
    """Texts without white space and case give the scores of the raw ones, and the query makes each element's only once."""
    from spandrel.plans import benchmark_queries as q

    texts = ["第1章 The End", "- a　 B", "資料來源: X", "圖 1 e", None]
    kinds = ["heading", "list", "footnote", "table", "paragraph"]
    els = lambda form: F.array(*(F.struct(F.lit(k).alias("type"), form(F.lit(t).cast("string")).alias("text"), F.lit(i + 1).alias("page"), F.lit("").alias("markdown"), F.lit(3).alias("row_count"), F.lit(2).alias("column_count"), *(F.lit(v).alias(c) for v, c in zip((0.1, 0.1, 0.5, 0.5), geometry.BOX, strict=True))) for i, (k, t) in enumerate(zip(kinds, texts, strict=True))))
    whole = F.lit("\n".join(t or "" for t in texts))
    scores = lambda e, t, **k: [evaluation.typed_elements(e, F.array(F.struct(F.lit("list").alias("type"), F.lit("- A b").alias("text"))), **k), evaluation.footnote_anchor(t, e, F.lit("圖 1"), F.lit("資料來源"), **k), evaluation.continuity(e, F.lit("資料 來源"), F.lit("圖 1"), **k), evaluation.table_structure(e, F.lit("E"), F.lit(3), F.lit(2), F.array(F.lit("1"), F.lit("zz")), **k), evaluation.grounding(e, F.lit("the e"), tuple(F.lit(x) for x in (0.1, 0.1, 0.5, 0.5)), **k), evaluation.completeness(t, F.array(F.lit("the"), F.lit("zz")), **k)]
    raw, ready = scores(els(lambda x: x), whole), scores(els(TX.compact), TX.compact(whole), ready=True)
    assert one(spark, F.array(*raw)) == one(spark, F.array(*ready)) == [1.0, 0.75, 1.0, 0.75, 1.0, 0.5]
    plan = q.e_parser_cases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("regexp_replace")
