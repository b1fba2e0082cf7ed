"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

1. Evidence. A logistic regression over hashed words (Spark's own), fitted on a bounded, hash-ordered sample of the
   labelled documents, gives every document the log odds that its text adds to the base rate.
2. Sites. Over all documents, grouped sums of labels (where known) and of probabilities (elsewhere) give each host and
   each path its rate. Beta priors are fitted by moments: hosts shrink toward the global rate, paths toward their
   host, the more the fewer documents they have.
3. Verdict. A document's posterior adds its evidence to the log odds of its path; it is kept if the odds of good
   quality are at least even, and, as labels mark toxic documents too, the odds of toxicity are not.

The site columns are the caller's: `site_of` reads host and path from a URL. The table `documents` has no URL, so there the
registered query and the pipeline take `source` as the host and `lang` as its path.

Defined results: null, empty and blank texts have no words and are judged by the intercept and their site; null hosts
and paths are sites of their own; repeated rows count and are judged each; labels repeated for one id count by their
smallest values; without any labels of both kinds for a target its evidence is zero; equal odds keep a document; an
empty table has no verdicts; a text of any length is one row's work; columns of the caller's are packed away, so that no name can clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import packed, staged, words_of

TARGETS = ("quality", "toxic")
#: Labelled documents that a fit reads at most, in the order of a hash of their ids.
SAMPLE = 12_000
#: The largest prime below 2**16. With 2**16 a vector of coefficients takes over half a megabyte, which the JVM's
#: collector treats as a huge object: a fit then leaves hundreds of megabytes of such vectors behind on the driver.
BUCKETS = 65_521
#: Rows of the sample that one task of a fitting round reads.
FIT_ROWS = 6_000
#: The weight of the sum of absolute coefficients. On held-out labels of sf0.1 this one finds 78 % of toxic documents (137 of
#: 176) by their toxicity alone and keeps 98.2 % of clean ones; a larger one (0.0015) found fewer and kept no more.
REGULARISATION, ROUNDS, SEED = 0.0001, 60, 11


@dataclass(frozen=True)
class Evidence:
    """The fitted classifier of one target; None where there was nothing to fit. base: log odds in the sample."""

    target: str
    model: LogisticRegressionModel | None
    base: float


def hashed(df: DataFrame) -> DataFrame:
    """`df` with `words_hashed`: which hashed words its column `text` holds, lower-cased and without signs, with a word
    each for its share of signs and of capitals in steps of doubling."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)

    def share(name: str, pattern: str) -> Column:
        found = n - F.length(F.regexp_replace(text, pattern, ""))
        return F.concat(F.lit(name), F.floor(F.log2(1 + 1000 * found / (n + 1))).cast("string"))

    words = words_of(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", " ")))
    rows = df.withColumn("word_list", F.concat(words, F.array(share("#signs", "[#*$%&|<>!]"), share("#capitals", "[A-Z]"))))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="word_list", outputCol="words_hashed").transform(rows).drop("word_list")


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host in lower case, and the first part of the path; null where there is none."""
    path = F.regexp_extract(F.parse_url(url, F.lit("PATH")), "^/([^/]+)/", 1)
    return F.lower(F.parse_url(url, F.lit("HOST"))), F.nullif(path, F.lit(""))


def known_labels(labels: DataFrame, id_col: str) -> DataFrame:
    """One row an id (null ids and labels of neither kind go)."""
    one = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    return one.agg(*(F.min(F.col(t).cast("int")).alias(t) for t in TARGETS))


def fit(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Evidence]:
    """Classifiers from `texts` (id, text) and `labels` (id, targets): at most `sample` labelled documents, so their
    ids are broadcast safely."""
    chosen = staged(labels.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample), "labelled-sample")
    # the scan for the sample is as wide as the corpus, its few rows are not: every round would run a task for each file
    rows = staged(hashed(texts.join(F.broadcast(chosen), "id")).select("words_hashed", *TARGETS), "labelled-features").coalesce(max(1, -(-sample // FIT_ROWS)))
    out = []
    for target in TARGETS:
        own = rows.select("words_hashed", F.col(target).cast("double").alias("label")).filter("label in (0, 1)")
        count = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
        if len(count) < 2:
            out.append(Evidence(target, None, 0.0))
            continue
        model = LogisticRegression(featuresCol="words_hashed", maxIter=ROUNDS, regParam=REGULARISATION, elasticNetParam=1.0, standardization=False).fit(own)
        model = model.setPredictionCol("").setProbabilityCol("").setRawPredictionCol(f"raw_{target}")
        out.append(Evidence(target, model, math.log(count[1.0] / count[0.0])))
    return out


def evidence(texts: DataFrame, fitted: list[Evidence]) -> DataFrame:
    """`texts` without the text and with e_<target>, the log odds that a text adds to the base rate."""
    rows = hashed(texts).drop("text")
    for e in fitted:
        if e.model is None:
            rows = rows.withColumn(f"e_{e.target}", F.lit(0.0))
        else:
            rows = e.model.transform(rows).withColumn(f"e_{e.target}", vector_to_array(f"raw_{e.target}")[1] - e.base).drop(f"raw_{e.target}")
    return rows.drop("words_hashed")


def strength(groups: DataFrame, mean: str, rate: float) -> float:
    """Prior weight, in documents, of groups (n, s) around the column `mean`: beta-binomial moments."""
    within = max(rate * (1 - rate), 1e-6)
    r = groups.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2).alias("spread"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("g")).first()
    if not r["g"] or r["g"] < 2:
        return 1e4
    room = r["n"] - r["n2"] / r["n"] - (r["g"] - 1)
    rho = (r["spread"] - (r["g"] - 1) * within) / (within * room) if room > 0 else 0.0
    return 1 / min(max(rho, 1e-4), 0.5) - 1


def sites(scores: DataFrame, labels: DataFrame, fitted: list[Evidence]) -> DataFrame:
    """(host, path, prior_<target>, n): the log odds of each path after shrinking, from all of `scores` (id, host,
    path, e_<target>)."""
    joined = scores.join(labels, "id", "left")
    guess = {e.target: 1 / (1 + F.exp(-(F.col(f"e_{e.target}") + e.base))) for e in fitted}
    sums = [F.sum(F.coalesce(F.col(t).cast("double"), guess[t])).alias(f"s_{t}") for t in TARGETS]
    paths = staged(joined.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f"s_{t}").alias(f"host_s_{t}") for t in TARGETS))
    table = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", *[c for c in hosts.columns if c != "host"])
    total = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"host_s_{t}").alias(t) for t in TARGETS)).first()
    for t in TARGETS:
        rate = min(max((total[t] or 0.0) / (total["n"] or 1), 1e-4), 1 - 1e-4)
        of_hosts = strength(hosts.select(F.col("host_n").alias("n"), F.col(f"host_s_{t}").alias("s"), F.lit(rate).alias("m")), "m", rate)
        host_rate = (F.col(f"host_s_{t}") + of_hosts * rate) / (F.col("host_n") + of_hosts)
        table = table.withColumn(f"host_{t}", host_rate)
        of_paths = strength(table.select("n", F.col(f"s_{t}").alias("s"), F.col(f"host_{t}").alias("m")), "m", rate)
        path_rate = (F.col(f"s_{t}") + of_paths * F.col(f"host_{t}")) / (F.col("n") + of_paths)
        table = table.withColumn(f"prior_{t}", F.log(path_rate / (1 - path_rate)))
    return staged(table.select("host", "path", "n", *(f"prior_{t}" for t in TARGETS)), "sites")


def judged(scores: DataFrame, table: DataFrame) -> DataFrame:
    """`scores` with p_<target> and `kept`. Sites join by whatever plan their written size allows."""
    s, t = scores.alias("s"), table.alias("t")
    on = F.col("s.host").eqNullSafe(F.col("t.host")) & F.col("s.path").eqNullSafe(F.col("t.path"))
    rows = s.join(t, on).select("s.*", *(f"t.prior_{x}" for x in TARGETS))
    odds = {x: F.col(f"e_{x}") + F.col(f"prior_{x}") for x in TARGETS}
    rows = rows.select("*", *((1 / (1 + F.exp(-odds[x]))).alias(f"p_{x}") for x in TARGETS))
    return rows.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


def _texts(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))


@dataclass(frozen=True)
class Classifier:
    fitted: list[Evidence]
    table: DataFrame
    scores: DataFrame


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> Classifier:
    """Fits the evidence, scores every document once (the scores are written, the texts are not) and learns the sites."""
    texts = _texts(docs, id_col, text_col, F.col(host_col), F.col(path_col))
    known = staged(known_labels(labels, id_col), "labels")
    fitted = fit(texts.select("id", "text"), known, sample)
    scores = staged(evidence(texts, fitted), "evidence")
    return Classifier(fitted, sites(scores, known, fitted), scores)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """(id, host, path, e_<target>, prior_<target>, p_<target>, kept) of every row."""
    c = learn(docs, labels, id_col, **names)
    return judged(c.scores, c.table).withColumnRenamed("id", id_col)


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, with their own columns. Each text is scored once: rows are written with
    their scores, from which the sites are learnt and the verdicts read."""
    known = staged(known_labels(labels, id_col), "labels")
    fitted = fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known, sample)
    rows = packed(docs, id_col, text_col).select("*", F.col(f"row.{host_col}").cast("string").alias("host"), F.col(f"row.{path_col}").cast("string").alias("path"))
    scored = staged(evidence(rows, fitted), "evidence")
    table = sites(scored.drop("row"), known, fitted)
    return judged(scored, table).filter("kept").select("row.*")
