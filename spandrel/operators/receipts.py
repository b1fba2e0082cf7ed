"""Scoring of extracted receipts against gold: fields, items, summaries, latency, cost, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from spandrel.functions import receipts as R
from spandrel.operators import item_matching
from spandrel.operators.quantiles import FEW, quantiles
from spandrel.sources.tables import importable

ITEM_THRESHOLD = 0.6
FUZZY_THRESHOLD = 0.8
PAIRS = "array<struct<s:double,i:int,j:int>>"
MATCHES = "array<struct<gt_idx:int,pred_idx:int,sim:double,amount_exact:boolean>>"


def field_scores(pairs: DataFrame, key: str, fields: list[str], threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(key, field, exact, fuzzy, score) from columns gold_<field> and pred_<field>; one pass, no join."""
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"gold_{f}").cast("string").alias("g"), F.col(f"pred_{f}").cast("string").alias("p"))
    rows = pairs.select(key, F.explode(F.array(*map(one, fields))).alias("x"))
    score = R.fuzzy(F.col("x.g"), F.col("x.p"))
    return rows.select(key, F.col("x.field").alias("field"), R.exact(F.col("x.g"), F.col("x.p")).alias("exact"), (score >= threshold).alias("fuzzy"), F.round(score, 6).alias("score"))


def matched_items(gt: Column, pred: Column, threshold: float = ITEM_THRESHOLD) -> Column:
    """Greedy one-to-one alignment of two arrays of (name, amount): pairs by falling similarity, then places; pairs
    under the threshold and used items are passed over. A fold inside the row; most pairs are far apart, so only a near one
    is made a value of its own."""

    def pair(g: Column, i: Column, p: Column, j: Column) -> Column:
        alike = R.fuzzy(g["name"], p["name"])
        return F.when(alike >= threshold, F.struct((-alike).alias("s"), i.alias("i"), j.alias("j")))

    near = F.transform(gt, lambda g, i: F.filter(F.transform(pred, lambda p, j: pair(g, i, p, j)), lambda x: x.isNotNull()))
    ordered = F.sort_array(F.coalesce(F.flatten(near), F.array().cast(PAIRS)))
    same = lambda x: F.get(gt, x["i"])["amount"].eqNullSafe(F.get(pred, x["j"])["amount"])

    def take(acc: Column, x: Column) -> Column:
        used = F.exists(acc, lambda m: (m["gt_idx"] == x["i"]) | (m["pred_idx"] == x["j"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(_match(x["i"], x["j"], -x["s"], same(x)))))

    return F.aggregate(ordered, F.array().cast(MATCHES), take)


def _match(i: Column, j: Column, s: Column, same: Column) -> Column:
    return F.struct(i.cast("int").alias("gt_idx"), j.cast("int").alias("pred_idx"), s.cast("double").alias("sim"), same.cast("boolean").alias("amount_exact"))


def align_items(gt: Column, pred: Column, threshold: float = ITEM_THRESHOLD) -> Column:
    """The matched items (see matched_items), then the unmatched of both sides."""
    places = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    null, no = F.lit(None), F.lit(False)

    def rest(acc: Column) -> Column:
        left = F.filter(places(gt), lambda i: ~F.exists(acc, lambda m: m["gt_idx"] == i))
        right = F.filter(places(pred), lambda j: ~F.exists(acc, lambda m: m["pred_idx"] == j))
        return F.concat(acc, F.transform(left, lambda i: _match(i, null, F.lit(0.0), no)), F.transform(right, lambda j: _match(null, j, F.lit(0.0), no)))

    return F.get(F.transform(F.array(matched_items(gt, pred, threshold)), rest), F.lit(0))


def item_scores(aligned: DataFrame, key: str) -> DataFrame:
    """Precision, recall, F1, and over matches the share of equal amounts and of equal names and the mean similarity of names,
    of (key, gt_idx, pred_idx, sim, amount_exact). Without items on one side precision or recall is 1, without a match the
    shares are null."""
    tp = F.sum(F.when(F.col("gt_idx").isNotNull() & F.col("pred_idx").isNotNull(), 1).otherwise(0))
    fn, fp = F.sum(F.when(F.col("gt_idx").isNotNull() & F.col("pred_idx").isNull(), 1).otherwise(0)), F.sum(F.when(F.col("gt_idx").isNull() & F.col("pred_idx").isNotNull(), 1).otherwise(0))
    both = F.col("gt_idx").isNotNull() & F.col("pred_idx").isNotNull()
    sums = aligned.groupBy(key).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.sum(F.when(both & F.col("amount_exact"), 1).otherwise(0)).alias("same"), F.sum(F.when(both & (F.col("sim") == 1.0), 1).otherwise(0)).alias("names"), F.sum(F.when(both, F.col("sim"))).alias("alike"))
    return _item_rates(sums, key)


def record_scores(records: DataFrame, key: str, gt: str, pred: str, threshold: float = ITEM_THRESHOLD) -> DataFrame:
    """The scores of item_scores from a row a record with both arrays of (name, amount): records are matched a batch at a time
    (see item_matching), what is unmatched being the rest of both sizes. A record without any item has no scores."""
    importable(records.sparkSession)
    size = lambda a: F.when(F.col(a).isNotNull(), F.size(a)).otherwise(0)
    amounts = [F.col(a)["amount"] for a in (gt, pred)]
    both = records.filter((size(gt) > 0) | (size(pred) > 0)).select(key, F.col(gt)["name"].alias("a"), amounts[0].alias("x"), F.col(pred)["name"].alias("b"), amounts[1].alias("y"), F.concat(*amounts).alias("all"))
    kind = both.schema["all"].dataType  # amounts are compared as what both kinds are
    rows = both.select(key, "a", F.col("x").cast(kind), "b", F.col("y").cast(kind))
    schema = T.StructType([both.schema[key], *(T.StructField(n, T.LongType()) for n in ("tp", "fp", "fn", "same", "names")), T.StructField("alike", T.DoubleType())])
    return _item_rates(rows.mapInArrow(lambda batches: item_matching.sums(batches, threshold), schema), key)


def _item_rates(sums: DataFrame, key: str) -> DataFrame:
    share = lambda a: F.when(F.col("tp") > 0, F.col(a) / F.col("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = sums.select(key, p.alias("precision"), r.alias("recall"), share("same").alias("amount_accuracy"), share("names").alias("name_exact_rate"), share("alike").alias("name_avg_similarity"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.select(key, *(F.round(c, 6).alias(n) for n, c in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", f1), *((n, F.col(n)) for n in ("amount_accuracy", "name_exact_rate", "name_avg_similarity")))))


def config_summary(scores: DataFrame, config: str, fields: list[str]) -> DataFrame:
    """A row a configuration: count and mean exact and fuzzy rate of every field; one shuffle."""
    means = [F.round(F.avg(F.when(F.col("field") == f, F.col(m).cast("int"))), 6).alias(f"{m}_{f}") for f in fields for m in ("exact", "fuzzy")]
    return scores.groupBy(config).agg(F.sum(F.when(F.col("field") == fields[0], 1).otherwise(0)).alias("n"), *means)


def item_summary(scores: DataFrame, config: str, measured: str) -> DataFrame:
    """A row a configuration: means of its records' item scores (see item_scores); records without a match have no
    shares and do not count in their means. A configuration that extracts no items (`measured` false) has null means."""
    means = [F.round(F.avg(F.when(F.col(measured), F.col(m))), 6).alias(f"items_{m}") for m in ("precision", "recall", "f1", "amount_accuracy", "name_exact_rate", "name_avg_similarity")]
    return scores.groupBy(config).agg(*means)


def challenge_pivot(scores: DataFrame, key: str, config: str, challenge: str, values: list[int]) -> DataFrame:
    """Mean over records of a record's mean exact rate, a column a challenge."""
    one = scores.groupBy(key, config, challenge).agg(F.avg(F.col("exact").cast("int")).alias("m"))
    return one.groupBy(config).agg(*(F.round(F.avg(F.when(F.col(challenge) == v, F.col("m"))), 6).alias(f"challenge_{v}") for v in values))


def challenge_f1(scores: DataFrame, manifest: DataFrame, key: str, config: str, challenge: str, values: list[int]) -> DataFrame:
    """Mean item F1 of a configuration, a column a challenge, from scores (key, config, f1) and the challenge that
    `manifest` (key, challenge) has for each record; a record that it lacks is an error."""
    rows = scores.join(manifest.select(key, F.col(challenge).alias("of"), F.lit(True).alias("listed")), key, "left")
    known = F.when(F.col("listed"), F.col("of")).otherwise(F.raise_error(F.concat(F.lit("not in the manifest: "), F.col(key).cast("string"))).cast("int"))
    return rows.withColumn("of", known).groupBy(config).agg(*(F.round(F.avg(F.when(F.col("of") == v, F.col("f1"))), 6).alias(f"challenge_{v}") for v in values))


def latency(calls: DataFrame, config: str, order: list[str], value: str, few: int = FEW) -> DataFrame:
    """(config, cold, n, p50, p95, mean): the first call of a configuration apart from the others. The first comes from an
    aggregate and quantiles from `quantiles`, so no configuration has to be held or sorted as a whole."""
    first = calls.groupBy(config).agg(F.min(F.struct(*order)).alias("first"))
    rows = calls.join(first, config).select(config, (F.struct(*order) == F.col("first")).alias("cold"), F.col(value).alias("v"))
    means = rows.groupBy(config, "cold").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    middle = quantiles(rows, [config, "cold"], "v", {"p50": 0.5, "p95": 0.95}, few)
    return means.join(middle, [config, "cold"]).select(config, "cold", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean")


def api_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Dollars of 100 documents from mean tokens and dollars a million tokens."""
    return 100 * (tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out)


def gpu_cost(seconds: Column, dollars_hour: float) -> Column:
    return seconds / 3600 * dollars_hour * 100


def stability(runs: DataFrame, key: str, fields: list[str], valid: str) -> DataFrame:
    """(key, n_runs, n_valid, validity_rate, consistency of each field): the share of the commonest value, null being
    one, over valid runs; null without any. Fields are counted in one grouped pass over unpivoted rows."""
    base = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.when(F.col(valid), 1).otherwise(0)).alias("n_valid"))
    long = runs.filter(valid).select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x"))
    counts = long.groupBy(key, "x.f", "x.v").agg(F.count(F.lit(1)).alias("c"))
    share = counts.groupBy(key).agg(*(F.round(F.max(F.when(F.col("f") == f, F.col("c"))) / F.sum(F.when(F.col("f") == f, F.col("c"))), 6).alias(f) for f in fields))
    return base.join(share, key, "left").select(key, "n_runs", "n_valid", F.round(F.col("n_valid") / F.col("n_runs"), 6).alias("validity_rate"), *fields)


def first_valid_attempt(attempts: DataFrame, call: str, attempt: str, valid: Column) -> DataFrame:
    """(call, attempts, is_valid): the number of attempts made up to the first valid one, or all of them."""
    rows = attempts.groupBy(call).agg(F.min(F.when(valid, F.col(attempt))).alias("first"), F.collect_list(attempt).alias("all"), F.count(F.lit(1)).alias("n"))
    upto = F.filter("all", lambda n: F.col("first").isNull() | (n <= F.col("first")))  # a call has a few attempts
    return rows.select(call, F.when(F.col("first").isNull(), F.col("n")).otherwise(F.size(upto)).alias("attempts"), F.col("first").isNotNull().alias("is_valid"))


def numbered(items: DataFrame, key: str, order: list[str], name: str = "idx") -> DataFrame:
    """Items numbered from 0 within their record, by a total order."""
    return items.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def listed(items: DataFrame, key: str, order: list[str], value: Column, name: str, **more: Column) -> DataFrame:
    """(key, name, and so for each of `more`): a row a record with the values of its items as an array in a total order, nulls
    left out. The sort that the order needs is the only one: a grouped list would be sorted by key for itself, and then each
    list anew."""
    w = W.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lists = (F.collect_list(v).over(whole).alias(n) for n, v in {name: value, **more}.items())
    return items.select(key, F.row_number().over(w).alias("nth_"), *lists).filter("nth_ = 1").drop("nth_")
