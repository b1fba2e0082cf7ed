"""Spelling variants, vector codes and language mixtures against brute force, on odd and empty tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import language_mixture, queries, spelling_variants, vector_codes

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from comparison import database, differences  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert differences(df.collect(), df.columns, database(FOLDER), queries.ORACLES[name]) == ""


# --- spelling variants -----------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            if i is not None and (h := zlib.crc32(f"{i}:{word}".encode())) % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def expected_variants(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, len(near))
    return out


def variant_rows():
    r = random.Random(5)
    stems = ["colour", "Straße", "árboles", "analyse", "éééééé", "aaaaaa", "aaaaaaa", "bananas", "ÀÿÀÿÀÿ", "x÷y×zzz"]
    words = []
    for stem in stems:
        words += [stem] * 200
        for _ in range(30):
            i = r.randrange(len(stem))
            words += [r.choice([stem[:i] + stem[i + 1 :], stem[:i] + r.choice("abzéÿ") + stem[i:], stem[:i] + r.choice("abzéÿ") + stem[i + 1 :]])] * r.choice([1, 5, 5, 5, 41, 1000])
    words += ["short"] * 50 + ["Twelve12Twelve"] * 9
    r.shuffle(words)
    texts = [" ".join(words[i : i + 97]) for i in range(0, len(words), 97)]
    return [*enumerate(texts), (0, texts[0]), (0, texts[0]), (None, texts[1]), (9_000_001, None), (9_000_002, ""), (9_000_003, " \n"), (9_000_004, "doubled " * 50_000), (-5, "İstanbul naïve_words " * 7)]


@pytest.mark.parametrize("frame", [1, 1024])
def test_variants_against_brute_force(spark, frame):
    rows = variant_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    want, got = expected_words(rows), {r.word: r for r in spelling_variants.variants(docs, frame=frame).collect()}
    assert {w: r.n for w, r in got.items()} == want
    near = expected_variants(want)
    assert {w: (r.form, r.n_near) for w, r in got.items()} == near and any(f for f, _ in near.values())
    for w, r in got.items():
        end = w
        while near[end][0]:
            end = near[end][0]
        assert r.root == end and r.form_n == (want[r.form] if r.form else None)
    assert any(r.root != r.form for r in got.values() if r.form)


def test_every_near_pair_is_found_once(spark):
    words = ["".join(p) for n in (1, 2, 3) for p in itertools.product("abé", repeat=n)] + ["longerword", "longerworde", "lomgerword"]
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    want = sorted((a, b) for a, b in itertools.combinations(sorted(words), 2) if one_edit(a, b))
    for limit in (1, 4, 1000):
        assert sorted((r.word, r.other) for r in spelling_variants.near_words(frame, limit).collect()) == want


def test_no_words(spark):
    assert spelling_variants.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling_variants.variants(spark.createDataFrame([(1, None), (2, "a b"), (3, "")], "doc_id long, text string")).collect() == []


# --- vector codes ----------------------------------------------------------------------------------------------------


def expected_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**50 else int(x) * 1024 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[best(v, p)[1]].append(cut(v, p))
            for k, members in groups.items():
                new[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        books = new
    out = []
    for i, v, label in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    by = collections.Counter()
    for _, _, e, label in out:
        by[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in out), key=repr)


def vector_rows(n=300, dim=8, offset=0.0):
    r = random.Random(3)
    rows = [(i, [offset + r.choice([-2.0, -0.3, 0.0, 0.5, 1.0]) + (r.random() < 0.3) * r.random() for _ in range(dim)], r.choice([0, 1, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [1.0] * (dim - 1) + [None], 0), (n + 3, [float("inf")] * dim, None)]
    return rows + rows[:40] + [(None, rows[0][1], 0), (-7, [offset + 0.25] * dim, 2)]


SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


@pytest.mark.parametrize("offset", [0.0, 2.0**40])
def test_codes_against_brute_force(spark, offset):
    """With the offset, products of components leave 64 bits, so that Python's integers are needed."""
    rows = vector_rows(offset=offset)
    vectors = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    for parts, entries, rounds in ((4, 16, 4), (1, 3, 2)):
        got = [tuple(r) for r in vector_codes.codes(vectors.repartition(5), parts, entries, rounds).collect()]
        assert sorted(got, key=repr) == expected_codes(rows, parts, entries, rounds)


def test_fewer_vectors_than_entries(spark):
    rows = vector_rows(20)
    got = [tuple(r) for r in vector_codes.codes(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=repr) == expected_codes(rows, 4, 256, 4)


def test_search_keeps_the_lowest_index_of_ties():
    r = np.random.default_rng(1)
    entries = r.integers(-3, 4, (200, 5))
    asked = r.integers(-4, 5, (3000, 5))
    found, far = vector_codes.nearest(vector_codes.tree(entries), asked)
    all_ = ((asked[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()
    same = np.zeros((50, 5), np.int64)
    assert (vector_codes.nearest(vector_codes.tree(same), asked)[0] == 0).all()


def test_vectors_that_cannot_be_coded(spark):
    assert vector_codes.codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect() == []
    for rows in ([(1, [0.0] * 6, 1, "", "")], [(1, [0.0] * 4, 1, "", ""), (2, [0.0] * 8, 1, "", "")]):
        with pytest.raises(Exception, match="length"):
            vector_codes.codes(spark.createDataFrame(rows, SCHEMA)).collect()


# --- language mixtures -----------------------------------------------------------------------------------------------


def plain_grams(text):
    clean = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return [clean[i : i + 3] for i in range(len(clean) - 2)]


def test_grams_equal_plain_ones_in_blocks_of_any_size():
    for text in ("Straße, 12 ÉTÉ! 你好 x", "", "...", "a", "no  gaps\n\n here " * 30, "𝔘nicode 𝕏"):
        want = collections.Counter()
        for g in plain_grams(text):
            points = np.array([ord(c) for c in g], np.uint64)
            want[int(language_mixture.hashed(points, 1, 3, 4096)[0])] += 1
        for block in (1, 2, 7, 1000):
            got = language_mixture.grams(text, buckets=4096, block=block)
            assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want), (text, block)


def plain_selection(table, n, first, penalty):
    """Every set that grows from `first` one language at a time, each fitted by long plain iteration."""

    def fitted(columns):
        share = [1 / len(columns)] * len(columns)
        for _ in range(3000):
            new = [0.0] * len(columns)
            for row, count in zip(table, n, strict=True):
                total = sum(s * row[c] for s, c in zip(share, columns, strict=True))
                for k, c in enumerate(columns):
                    new[k] += count * share[k] * row[c] / total
            share = [x / sum(n) for x in new]
        return sum(count * math.log(sum(s * row[c] for s, c in zip(share, columns, strict=True))) for row, count in zip(table, n, strict=True)), share

    chosen = [first]
    best, share = fitted(chosen)
    while trials := [(*fitted([*chosen, c]), c) for c in range(len(table[0])) if c not in chosen]:
        top = max(trials, key=lambda t: t[0])
        if top[0] - best <= penalty:
            break
        best, share, chosen = top[0], top[1], [*chosen, top[2]]
    return chosen, share


def test_selection_equals_plain_expectation_maximisation():
    r = np.random.default_rng(8)
    sizes = set()
    for _ in range(12):
        table = r.dirichlet(np.full(30, 0.3), 4).T + 1e-6
        table /= table.sum(axis=0)
        true = r.choice([[1, 0, 0, 0], [0.6, 0.4, 0, 0], [0.2, 0.3, 0.5, 0], [0, 0, 0.05, 0.95]])
        n = np.bincount(r.choice(30, 150, p=(table * true).sum(axis=1) / (table * true).sum()), minlength=30) + 1
        first = int((n @ np.log(table)).argmax())
        chosen, share = language_mixture.selected(np.log(table), n, first, 4.0)
        want, shares = plain_selection(table.tolist(), n.tolist(), first, 4.0)
        assert chosen == want and np.allclose(share, shares, atol=5e-3)
        sizes.add(len(chosen))
    assert len(sizes) > 1


SYLLABLES = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["der", "und", "ung", "sch", "ö"], "cc": ["que", "eau", "è", "les", "oi"]}


def language_rows():
    r = random.Random(4)
    word = lambda lang: "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(r.randint(1, 60))), lang) for i in range(600) for lang in [r.choice([*SYLLABLES])]]
    mixed = [(10_000 + i, " ".join([word("aa") for _ in range(40)] + [word("cc") for _ in range(100)]), None) for i in range(20)]
    return rows + mixed + rows[:3] + [(20_000, None, "aa"), (20_001, "", "bb"), (20_002, " 12 \n ... ½²", "cc"), (None, "und der schung", "bb"), (20_003, "und sch " * 100_000, None)]


def test_languages_of_held_out_documents(spark):
    rows = language_rows()
    docs = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, score double").repartition(4)
    found = language_mixture.languages(docs).collect()
    assert len(found) == len(rows)
    want = collections.defaultdict(list)
    for i, t, lang in rows:
        want[i].append((t, lang))
    right = total = 0
    for r in found:
        text, lang = want[r.doc_id][0]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.doc_id is not None and r.doc_id < 1000 and r.held_out:
            total, right = total + 1, right + (r.lang_pred == lang)
        if r.doc_id is not None and 10_000 <= r.doc_id < 10_020:
            assert r.lang_pred == "cc" and r.langs == ["cc", "aa"] and 0.6 < r.shares[0] < 0.85
    assert total > 150 and right / total > 0.97
    again = {(r.doc_id, r.lang_pred, r.score) for r in language_mixture.languages(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.lang_pred, r.score) for r in found}


def test_language_source_and_id_are_no_inputs(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = language_mixture.learn(docs)
    moved = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    a, b = (sorted((r.lang_pred, r.score) for r in language_mixture.predict(d, model).collect()) for d in (docs, moved))
    assert a == b


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_mixture.languages(none).collect() == []
    rows = language_mixture.languages(spark.createDataFrame([(2, "some words", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
