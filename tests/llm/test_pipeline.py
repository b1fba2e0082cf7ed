"""The five stages of the pipeline on a small corpus, each against brute force, and on odd and empty tables."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spandrel.llm import simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id int"
KEY = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


def corpus():
    r = random.Random(2)
    prose = lambda n: " ".join(f"w{r.randrange(900)}ord" for _ in range(n))
    texts = [prose(120) for _ in range(30)]
    near = texts[0].split()
    near[60] = "changed"
    texts += [texts[1], texts[1], " ".join(near), prose(5), "# * $ % & " * 40, prose(60) + f' token = "{KEY}" ' + prose(60), None, "", prose(30_000), "repeat these eight words again and again here " * 10]
    return [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"file://{path}/documents.parquet")
    rows = [(i, int(i not in (33, 34)), 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def fails_rules(text):
    words = WORD.findall(text or "")
    n = len(words)
    at = collections.defaultdict(list)
    for i in range(n - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = len({i + o for x in at.values() if len(x) > 1 for i in x for o in range(8)})
    chars = sum(map(len, words))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n < 20 or 100 * repeated > 30 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or not 2 * n <= chars <= 20 * n or 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or 2 * len(re.findall("[A-Z]", text)) > chars


def test_rules_stage(spark, docs, folder):
    kept = corpus_pipeline.rules_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t, *_ in corpus() if not fails_rules(t)]


def test_classifier_stage(spark, docs, folder):
    kept = corpus_pipeline.classifier_stage(spark, docs, folder)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and ids >= set(range(30)) and 34 not in ids


def test_near_duplicate_stage(spark, docs, folder):
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    grams = {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t, *_ in corpus()}
    gone = {j for j in grams for i in grams if i < j and (grams[i] == grams[j] or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]))}
    assert gone >= {30, 31, 32} and kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(grams) - gone


def test_secrets_stage(spark, docs, folder):
    out = {r.doc_id: r for r in corpus_pipeline.secrets_stage(spark, docs, folder).collect()}
    for i, t, *_ in corpus():
        want = t.replace(KEY, "[SECRET]") if t else t
        assert out[i].text == want and out[i].n_chars == (None if t is None else len(want))


def test_packing_stage(spark, docs, folder):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = collections.Counter()
    for r in corpus_pipeline.packing_stage(spark, docs, folder).collect():
        size[r.doc_id] += r.length
    assert size == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in corpus()}


def test_run_is_the_stages_in_turn(spark, folder):
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got >= set(range(30)) and not got & {30, 31, 32, 33, 34, 36, 37, 39}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, docs, folder, stage):
    none = docs.filter(F.lit(False))
    out = corpus_pipeline.STAGES[stage][1](spark, none, folder)
    assert out.collect() == [] and (stage == 4 or out.columns == docs.columns)


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_nulls_in_any_column(spark, folder, stage):
    """Rows without id, language or source go through every stage; of equal texts the row with the smallest id stays."""
    prose = lambda n: " ".join(f"v{(n * i * 7919) % 997}word" for i in range(1, 80))
    rows = [(None, prose(2), None, None, None, None, None), (51, prose(3), None, "a", None, None, 1), (52, prose(5), "en", None, 9, "x", None), (None, prose(7), "en", "a", 9, "x", 1), (53, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.STAGES[stage][1](spark, odd, folder)
    if stage == 4:
        assert {r.doc_id for r in out.collect()} == {None, 51, 52, 53}
    else:
        got = sorted((r.text or "" for r in out.collect()))
        want = sorted(r[1] or "" for r in rows if not (stage == 0 and r[1] is None))
        assert out.columns == odd.columns and (got == want or stage == 1 and set(got) <= set(want))


def test_parities_never_differ_by_more_than_the_sets():
    r = np.random.default_rng(5)
    for _ in range(300):
        n, m, both = r.integers(0, 400, 3)
        common = r.integers(0, 1 << 63, both, np.uint64)
        a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, k, np.uint64)])) for k in (n, m))
        differ = len(np.setxor1d(a, b))
        bits = int(np.bitwise_count(simhash_dedup.parities(a).view(np.uint64) ^ simhash_dedup.parities(b).view(np.uint64)).sum())
        assert bits <= differ and len(simhash_dedup.parities(a)) == len(simhash_dedup.WORDS)
        if len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)):
            assert bits * 9 <= len(a) + len(b)
