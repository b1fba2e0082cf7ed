"""Languages of documents as mixtures, by expectation-maximisation over n-grams of letters.

1. Learning. Texts are cut into n-grams of lower-cased letters, words bounded by a blank. Tasks count them by language in
   hashed buckets; Spark adds the counts of all labelled documents up. Only buckets x languages come to the driver.
2. Mixture. A document's n-grams are draws from a mixture of the languages' distributions; expectation-maximisation finds
   the shares of a set of languages.
3. Selection. From the best single language on, the language that raises the likelihood most joins the set while it
   raises it by more than the penalty. The log likelihood is concave in the shares, so its slope towards a language
   bounds what that language can add: most documents are settled without any iteration, exactly.

The predicted language has the largest share; the score is its share, times its posterior among single languages where
the set has one.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the smaller language; repeated
rows count and are judged each; rows without a language teach nothing; rows without an id teach and are not held out; a
text of any length is read in blocks; nothing learnt makes every text `und`; an empty table has no predictions. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import staged
from spandrel.sources.tables import importable

ORDER = 3
BUCKETS = 1 << 15
#: Added to each bucket's count.
SMOOTHING = 0.5
#: What a further language must add to the log likelihood, for each halving of its standard error: neighbouring n-grams
#: share letters, so each letter is counted ORDER times.
PENALTY = ORDER / 2
#: Iterations for one set of languages, and the change of a share at which they end.
ROUNDS, CLOSE = 200, 1e-5
#: Code points of a text that are read at a time.
BLOCK = 1 << 18
#: Languages that may be learnt: the model is broadcast, and has LANGUAGES * BUCKETS numbers at most. More is an error.
LANGUAGES = 512
FACTOR = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


class Letters:
    """Which code points are letters, looked up once a worker process."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table[points]


def grams(text: str, order: int = ORDER, buckets: int = BUCKETS, block: int = BLOCK) -> np.ndarray:
    """Counts of the n-grams of a text by bucket. Runs of what is no letter are one blank; texts begin and end with one."""
    total = np.zeros(buckets, np.int64)
    held = np.full(1, 32, np.uint64)
    for a in range(0, len(text) + 1, block):
        points = np.frombuffer((text[a : a + block].lower() + " " * (a + block > len(text))).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([held, np.where(Letters.of(points), points, 32).astype(np.uint64)])
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        n = len(points) - order + 1
        if n > 0:
            total += np.bincount(hashed(points, n, order, buckets), minlength=buckets)
        held = points[max(0, n) :]
    return total


def hashed(points: np.ndarray, n: int, order: int, buckets: int) -> np.ndarray:
    """Buckets of the n n-grams of some code points."""
    h = np.zeros(n, np.uint64)
    for i in range(order):
        h = (h ^ points[i : i + n]) * FACTOR
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """languages in ascending order; log_likelihood: buckets x languages; log_prior: of each language by documents."""

    languages: list[str]
    log_likelihood: np.ndarray
    log_prior: np.ndarray


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all documents with a language; bucket -1 counts the documents."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, np.zeros(buckets + 1, np.int64))
                own[:buckets] += grams(text or "", buckets=buckets)
                own[buckets] += 1
        for lang, own in held.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(np.where(used < buckets, used, -1)), pa.array(own[used])], ["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).cast("string"))
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Model:
    """The model of all `docs` that have a language."""
    summed = staged(counts(docs, text_col, lang_col, buckets), "ngram-counts")
    languages = [r["lang"] for r in summed.filter("bucket = -1").orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = np.zeros((buckets + 1, len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    for batch in summed.toArrow().to_batches():  # buckets x languages rows at most
        columns = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
        table[batch.column("bucket").to_numpy(), columns] = batch.column("n").to_numpy()
    likelihood = table[:buckets] + smoothing
    documents = table[buckets]
    return Model(languages, np.log(likelihood / likelihood.sum(axis=0)), np.log(documents / max(1.0, documents.sum())))


def shares(likelihood: np.ndarray, n: np.ndarray, start: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(shares, log likelihood) of the mixture of the columns of `likelihood`, each n-gram met n times."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1]) if start is None else start
    total = n.sum()
    for _ in range(rounds):
        mixed = likelihood * share
        new = (mixed * (n / mixed.sum(axis=1))[:, None]).sum(axis=0) / total
        done = np.abs(new - share).max() < CLOSE
        share = new
        if done:
            break
    return share, float(n @ np.log(likelihood @ share))


def selected(log_likelihood: np.ndarray, n: np.ndarray, first: int, penalty: float) -> tuple[list[int], np.ndarray]:
    """(languages, shares): from `first` on, the language that adds most joins while it adds more than the penalty."""
    scaled = np.exp(log_likelihood - log_likelihood.max(axis=1, keepdims=True))  # a factor for each n-gram changes no comparison
    scaled = np.maximum(scaled, 1e-300)
    chosen, share, total = [first], np.ones(1), n.sum()
    best = float(n @ np.log(scaled[:, first]))
    while True:
        mixed = scaled[:, chosen] @ share
        slope = (n / mixed) @ scaled - total  # what each language could add at most
        trials = []
        for other in np.flatnonzero(slope > penalty):
            if other not in chosen:
                columns = [*chosen, int(other)]
                trials.append((*reversed(shares(scaled[:, columns], n)), columns))
        reached = max(trials, key=lambda x: x[0], default=(best,))
        if reached[0] - best <= penalty:
            return chosen, share
        best, share, chosen = reached


def judged(text: str | None, model: Model, penalty: float = PENALTY) -> tuple[str, float, list[str], list[float]]:
    """(language, score, the languages of the set by share, their shares) of one text."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, [], []
    n = grams(text, buckets=len(model.log_likelihood))
    used = np.flatnonzero(n)
    n, own = n[used], model.log_likelihood[used]
    single = n @ own / ORDER + model.log_prior  # each letter counts once against the prior
    first = int(single.argmax())
    chosen, share = selected(own, n, first, penalty * np.log(1 + n.sum()))
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    langs, parts = [model.languages[chosen[i]] for i in order], [float(share[i]) for i in order]
    score = float(1 / np.exp(single - single[first]).sum()) if len(chosen) == 1 else parts[0]
    return langs[0], min(1.0, score), langs, parts


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(id, lang_pred, score, langs, shares) of every row; texts alone are read."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*fields, T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged(t, shared.value, penalty) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def held_out(id_: Column) -> Column:
    """Whether a document takes no part in learning: a third, by the checksum of its id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, langs, shares) of every row, by a model of the rows that are not held out."""
    model = learn(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    found = predict(docs, model, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "langs", "shares")
