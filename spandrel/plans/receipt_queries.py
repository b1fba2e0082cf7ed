"""Receipt-track queries over the driver's tables, each with its DuckDB twin.

Inputs are rendered from table columns by rules (dates in several styles, amounts with signs, perturbed predictions);
the twins state the expected result from the column itself where they can, so they check the functions independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import receipts as R
from spandrel.functions import text as TX
from spandrel.operators import receipts as O
from spandrel.operators.quantiles import quantiles
from spandrel.sources.tables import dealt, table

#: Dollars a million tokens in and out, and dollars a GPU hour.
PRICES = {"click": (0.15, 0.60), "view": (0.10, 0.40), "purchase": (2.50, 10.0), "signup": (0.30, 2.50)}
GPU_HOUR = 0.40
#: Signs and their full-width forms, by which every fourth raw value is written.
WIDE = ("0123456789/-.,$ABabNTRM", "０１２３４５６７８９／－．，＄ＡＢａｂＮＴＲＭ")


def f1_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Names with blanks of several kinds, letters and digits in full width, a ligature and a superscript."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("key"), TX.normalize_text(F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "　 # "), F.lit(" ｘ１ ﬁ² "))).alias("norm"))


def f3_normalize_date(spark: SparkSession, d: str) -> DataFrame:
    o, day, k = table(spark, d, "orders"), F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    roc = (F.year(day) - 1911).cast("string")
    raw = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.concat(F.lit("中華民國"), roc, F.lit("年"), F.date_format(day, "MM"), F.lit("月"), F.date_format(day, "dd"), F.lit("日")))
        .when(k == 2, F.date_format(day, "dd/MM/yyyy")).when(k == 3, F.date_format(day, "yyyyMMdd")).when(k == 4, F.concat(F.lpad(roc, 3, "0"), F.date_format(day, "MMdd"))).otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-13-"), F.date_format(day, "dd")))
    )
    raw = F.when(F.col("o_orderkey") % 4 == 1, F.translate(raw, *WIDE)).otherwise(raw)
    return o.select(F.col("o_orderkey").alias("key"), raw.alias("raw")).select("key", "raw", R.date(F.col("raw")).alias("iso"))


def s21_date_formats(spark: SparkSession, d: str) -> DataFrame:
    o, day, k = table(spark, d, "orders"), F.to_date("o_orderdate"), F.col("o_orderkey") % 7
    raw = F.lit("no date")
    for i, f in enumerate(R.CORPUS_DATES):
        raw = F.when(k == i, F.date_format(day, f)).otherwise(raw)
    return o.select(F.col("o_orderkey").alias("key"), R.corpus_date(raw).alias("iso"))


def f4_normalize_amount(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 5
    cents = F.floor(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.expr("floor(o_totalprice * 100) div 100"), F.lpad((cents % 100).cast("string"), 2, "0")
    raw = F.when(k == 0, F.concat(F.lit("NT$"), F.format_number(whole, 0), F.lit("."), rest)).when(k == 1, F.concat(F.lit("RM "), whole.cast("string"), F.lit("."), rest)).when(k == 2, F.concat(F.lit("-"), whole.cast("string"))).when(k == 3, F.concat(whole.cast("string"), F.lit(" 元"))).otherwise(F.lit("n/a"))
    raw = F.when(F.col("o_orderkey") % 4 == 1, F.translate(raw, *WIDE)).otherwise(raw)
    raw = F.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("\t"), raw, F.lit("\n"))).otherwise(raw)
    return o.select(F.col("o_orderkey").alias("key"), raw.alias("raw")).select("key", "raw", R.amount(F.col("raw")).alias("amount"))


def f6_tax_id_checksum(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key")).unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("key")))
    rows = keys.select("key", R.tax_id(F.concat(F.lit("id "), F.lpad((F.col("key") * 7919 % 100_000_000).cast("string"), 8, "0"))).alias("tax_id"))
    return rows.select("key", "tax_id", R.tax_id_valid(F.col("tax_id")).alias("valid"))


def f7_invoice_number(spark: SparkSession, d: str) -> DataFrame:
    o, k, n = table(spark, d, "orders"), F.col("o_orderkey") % 4, F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    raw = F.when(k == 0, F.concat(F.lit("AB-"), n)).when(k == 1, F.concat(F.lit("ab "), n)).when(k == 2, F.concat(F.lit("ABC"), n)).otherwise(F.concat(F.lit("x–Y"), n))
    raw = F.when(F.col("o_orderkey") % 3 == 1, F.translate(raw, *WIDE)).otherwise(raw)
    return o.select(F.col("o_orderkey").alias("key"), R.invoice_number(raw).alias("invoice_number"))


def perturbed(name, k):
    """A predicted name: as it is, its last character lost, its first changed, upper case, null, or quite another."""
    return F.when(k == 0, name).when(k == 1, F.expr("substring(p_name, 1, length(p_name) - 1)")).when(k == 2, F.concat(F.lit("#"), F.expr("substring(p_name, 2)"))).when(k == 3, F.upper(name)).when(k == 4, F.lit(None).cast("string")).otherwise(F.lit("other thing"))


PERTURBED_SQL = "CASE {k} WHEN 0 THEN p_name WHEN 1 THEN substring(p_name, 1, length(p_name) - 1) WHEN 2 THEN '#' || substring(p_name, 2) WHEN 3 THEN upper(p_name) WHEN 4 THEN NULL ELSE 'other thing' END"


def f9_fuzzy_score(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    score = R.fuzzy(F.col("p_name"), perturbed(F.col("p_name"), F.col("p_partkey") % 6))
    return p.select("p_partkey", F.round(score, 6).alias("score"), (score >= O.FUZZY_THRESHOLD).alias("is_match"))


FIELDS = ["doc_type", "seller_name", "date", "invoice_number", "seller_tax_id", "buyer_tax_id", "total_amount"]


def receipts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as gold records with predictions that err by rule."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    eight = lambda x: F.lpad((x * 7919 % 100_000_000).cast("string"), 8, "0")
    gold = {
        "doc_type": F.when(k % 9 != 0, "e_invoice").otherwise("receipt"),
        "seller_tax_id": eight(F.col("o_custkey")),
        "buyer_tax_id": F.when(k % 5 == 0, eight(k)),
        "seller_name": F.col("o_orderpriority"),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "invoice_number": F.when(k % 9 != 0, F.concat(F.lit("AB"), F.lpad(k.cast("string"), 8, "0"))),
        "total_amount": F.expr("cast(floor(o_totalprice) as bigint)").cast("string"),
    }
    pred = {
        "doc_type": F.when(k % 8 == 0, "receipt").otherwise(gold["doc_type"]),
        "seller_tax_id": F.when(k % 6 == 0, F.replace(gold["seller_tax_id"], F.lit("1"), F.lit("7"))).otherwise(gold["seller_tax_id"]),
        "buyer_tax_id": F.when(k % 7 == 3, "00000000").when(k % 10 != 5, gold["buyer_tax_id"]),
        "seller_name": F.when(k % 5 == 0, F.concat(gold["seller_name"], F.lit("!"))).when(k % 5 == 1, F.lit(None)).otherwise(gold["seller_name"]),
        "date": F.when(k % 7 == 0, F.lit("2001-01-01")).otherwise(gold["date"]),
        "invoice_number": F.when(k % 4 == 0, F.regexp_replace(gold["invoice_number"], "0", "8")).otherwise(gold["invoice_number"]),
        "total_amount": F.when(k % 3 == 0, F.concat(gold["total_amount"], F.lit("0"))).otherwise(gold["total_amount"]),
    }
    return o.select("o_orderkey", (k % 3).cast("int").alias("config"), (k % 7).cast("int").alias("challenge"), *(gold[f].alias(f"gold_{f}") for f in FIELDS), *(pred[f].alias(f"pred_{f}") for f in FIELDS))


RECEIPTS_SQL = """
g AS (SELECT o_orderkey, o_orderkey % 3 AS config, o_orderkey % 7 AS challenge, o_orderpriority AS g1, strftime(o_orderdate, '%Y-%m-%d') AS g2,
             CASE WHEN o_orderkey % 9 <> 0 THEN 'AB' || lpad(o_orderkey::VARCHAR, 8, '0') END AS g3, floor(o_totalprice)::BIGINT::VARCHAR AS g4, CASE WHEN o_orderkey % 9 <> 0 THEN 'e_invoice' ELSE 'receipt' END AS g5,
             lpad((o_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS g6, CASE WHEN o_orderkey % 5 = 0 THEN lpad((o_orderkey * 7919 % 100000000)::VARCHAR, 8, '0') END AS g7 FROM orders),
p AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN g1 || '!' WHEN o_orderkey % 5 = 1 THEN NULL ELSE g1 END AS p1, CASE WHEN o_orderkey % 7 = 0 THEN '2001-01-01' ELSE g2 END AS p2,
             CASE WHEN o_orderkey % 4 = 0 THEN replace(g3, '0', '8') ELSE g3 END AS p3, CASE WHEN o_orderkey % 3 = 0 THEN g4 || '0' ELSE g4 END AS p4, CASE WHEN o_orderkey % 8 = 0 THEN 'receipt' ELSE g5 END AS p5,
             CASE WHEN o_orderkey % 6 = 0 THEN replace(g6, '1', '7') ELSE g6 END AS p6, CASE WHEN o_orderkey % 7 = 3 THEN '00000000' WHEN o_orderkey % 10 <> 5 THEN g7 END AS p7 FROM g),
u AS (SELECT o_orderkey, config, challenge, 'seller_name' AS field, g1 AS g, p1 AS p FROM p UNION ALL SELECT o_orderkey, config, challenge, 'date', g2, p2 FROM p
      UNION ALL SELECT o_orderkey, config, challenge, 'invoice_number', g3, p3 FROM p UNION ALL SELECT o_orderkey, config, challenge, 'total_amount', g4, p4 FROM p
      UNION ALL SELECT o_orderkey, config, challenge, 'doc_type', g5, p5 FROM p UNION ALL SELECT o_orderkey, config, challenge, 'seller_tax_id', g6, p6 FROM p UNION ALL SELECT o_orderkey, config, challenge, 'buyer_tax_id', g7, p7 FROM p),
s AS (SELECT *, CASE WHEN g IS NULL AND p IS NULL THEN 1.0::DOUBLE WHEN g IS NULL OR p IS NULL THEN 0.0::DOUBLE ELSE 1 - levenshtein(g, p)::DOUBLE / greatest(length(g), length(p)) END AS raw FROM u),
a AS (SELECT o_orderkey, config, challenge, field, g IS NOT DISTINCT FROM p AS exact, raw >= 0.8 AS fuzzy, round(raw, 6) AS score FROM s)
"""


def a1_field_scores(spark: SparkSession, d: str) -> DataFrame:
    return O.field_scores(receipts(spark, d), "o_orderkey", FIELDS)


def _with_config(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return a1_field_scores(spark, d).select("*", (k % 3).cast("int").alias("config"), (k % 7).cast("int").alias("challenge"))


def a3_config_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.config_summary(_with_config(spark, d), "config", FIELDS)


def a11_challenge_pivot(spark: SparkSession, d: str) -> DataFrame:
    return O.challenge_pivot(_with_config(spark, d), "o_orderkey", "config", "challenge", list(range(7)))


def a11_items_f1(spark: SparkSession, d: str) -> DataFrame:
    """Means of item F1 by configuration and challenge; the challenge comes from a manifest of orders, an order that the
    manifest lacks is an error."""
    scores = a2_item_prf(spark, d).withColumn("config", (F.col("o_orderkey") % 3).cast("int"))
    manifest = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("challenge"))
    return O.challenge_f1(scores, manifest, "o_orderkey", "config", "challenge", list(range(7)))


def items(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, gt, pred): items of an order; predictions lose, rename or reprice items by place."""
    lines = table(spark, d, "lineitem")
    named = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), F.col("l_partkey") == F.col("p_partkey"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    placed = O.numbered(dealt(named, "l_orderkey", lines.count()), "l_orderkey", order, "i")
    k, name, amount = F.col("i") % 5, F.col("name"), F.col("l_extendedprice")
    wrong = F.when(k == 1, F.substring(name, F.lit(1), F.length(name) - 1)).when(k == 2, F.upper(name)).otherwise(name)
    predicted = F.when(F.col("i") % 4 != 3, F.struct(wrong.alias("name"), F.when(k == 4, amount + 1).otherwise(amount).alias("amount")))
    # predictions come in reverse, so order must not matter
    rows = O.listed(placed, "l_orderkey", order, F.struct("name", amount.alias("amount")), "gt", pred=predicted)
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "gt", F.reverse("pred").alias("pred"))


def t9_item_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).select("o_orderkey", F.explode(O.align_items(F.col("gt"), F.col("pred"))).alias("m"))
    return rows.select("o_orderkey", "m.gt_idx", "m.pred_idx", F.round("m.sim", 6).alias("sim"), "m.amount_exact")


def a2_item_prf(spark: SparkSession, d: str) -> DataFrame:
    return O.record_scores(items(spark, d), "o_orderkey", "gt", "pred")


def a3_item_means(spark: SparkSession, d: str) -> DataFrame:
    """Four configurations of orders by key; the last extracts no items."""
    scores = a2_item_prf(spark, d).withColumn("config", (F.col("o_orderkey") % 4).cast("int"))
    return O.item_summary(scores.withColumn("measured", F.col("config") != 3), "config", "measured")


ITEMS_SQL = """
l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, p_name AS n, l_extendedprice AS a
      FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY i DESC) - 1 AS j, CASE i % 5 WHEN 1 THEN substring(n, 1, length(n) - 1) WHEN 2 THEN upper(n) ELSE n END AS n, CASE i % 5 WHEN 4 THEN a + 1 ELSE a END AS a
      FROM l WHERE i % 4 <> 3),
c AS (SELECT l.o, l.i, q.j, 1 - levenshtein(l.n, q.n)::DOUBLE / greatest(length(l.n), length(q.n)) AS sim, l.a = q.a AS same FROM l JOIN q USING (o)),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY sim DESC, i, j) AS k FROM c WHERE sim >= 0.6),
b AS (SELECT o, max(k) AS last FROM r GROUP BY o),
w AS (SELECT o, 0::BIGINT AS k, 0::HUGEINT AS gi, 0::HUGEINT AS pj, false AS took, NULL::BIGINT AS i, NULL::BIGINT AS j FROM b
      UNION ALL
      SELECT w.o, r.k, CASE WHEN ok THEN w.gi | (1::HUGEINT << r.i::INTEGER) ELSE w.gi END, CASE WHEN ok THEN w.pj | (1::HUGEINT << r.j::INTEGER) ELSE w.pj END, ok, r.i, r.j
      FROM w JOIN (SELECT * FROM r) r ON r.o = w.o AND r.k = w.k + 1, LATERAL (SELECT (w.gi >> r.i::INTEGER) & 1 = 0 AND (w.pj >> r.j::INTEGER) & 1 = 0 AS ok)),
t AS (SELECT r.o, r.i, r.j, r.sim, r.same FROM w JOIN r USING (o, k) WHERE took),
m AS (SELECT o AS o_orderkey, i::INTEGER AS gt_idx, j::INTEGER AS pred_idx, sim, same AS amount_exact FROM t
      UNION ALL SELECT o, i::INTEGER, NULL, 0.0, false FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o = l.o AND t.i = l.i)
      UNION ALL SELECT o, NULL, j::INTEGER, 0.0, false FROM q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o = q.o AND t.j = q.j))
"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.col("value"), F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("tokens"))


def a5_latency_cold_warm(spark: SparkSession, d: str) -> DataFrame:
    return O.latency(_calls(spark, d), "event_type", ["ts", "event_id"], "value")


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "event_type string, rate_in double, rate_out double")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    means = _calls(spark, d).groupBy("event_type").agg(F.avg("tokens").alias("t_in"), F.avg(F.col("tokens") * 2).alias("t_out"), F.avg("value").alias("gpu"))
    return means.join(F.broadcast(_prices(spark)), "event_type", "left")


def a6_api_cost(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("event_type", F.round(O.api_cost(F.col("t_in"), F.col("t_out"), F.col("rate_in"), F.col("rate_out")), 6).alias("usd_per_100"))


def a7_gpu_cost(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("event_type", F.round(O.gpu_cost(F.col("gpu"), GPU_HOUR), 6).alias("usd_per_100"))


def a8_cost_branch(spark: SparkSession, d: str) -> DataFrame:
    """Tokens reported: priced by them, null for an unknown model; else by seconds."""
    u = _usage(spark, d).withColumn("t_in", F.when(~F.col("event_type").isin("click", "view"), F.col("t_in")))
    cost = F.when(F.col("t_in").isNotNull(), O.api_cost(F.col("t_in"), F.col("t_out"), F.col("rate_in"), F.col("rate_out"))).otherwise(O.gpu_cost(F.col("gpu"), GPU_HOUR))
    return u.select("event_type", F.round(cost, 6).alias("usd_per_100"))


def a9_field_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Consistency of the return flag over the lines of an order, null flags being a value."""
    return a10_stability(spark, d).select("l_orderkey", "l_returnflag")


def a10_stability(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", F.col("l_quantity").cast("long").alias("l_quantity"), (F.col("l_partkey") % 6 != 0).alias("valid"))
    return O.stability(runs, "l_orderkey", ["l_returnflag", "l_linestatus", "l_quantity"], "valid")


def a21_parse_timing(spark: SparkSession, d: str) -> DataFrame:
    e = _calls(spark, d)
    busy = F.sum(F.when(F.col("value") > 0, F.col("value")))
    sums = e.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.when(F.col("value") > 0, 1)) / busy, 6).alias("rate"))
    return sums.join(quantiles(e, ["user_id"], "value", {"median": 0.5}), "user_id").select("user_id", "total", F.round("median", 6).alias("median"), "rate")


def a22_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    e = _calls(spark, d).withColumn("tokens", F.when(F.col("user_id") % 3 != 0, F.col("tokens")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0.0))).alias("tokens"), F.max(F.col("tokens").isNotNull()).alias("reported"))


def t10_first_valid_attempt(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    raw = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Here: "), F.to_json(F.struct(F.col("role").alias("doc_type"), F.length("text").alias("n"))), F.lit(" ok"))).otherwise(F.col("text"))
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    valid = (body != "") & F.get_json_object(body, "$.n").isNotNull() & (F.get_json_object(body, "$.doc_type") != "user")
    return O.first_valid_attempt(c.select("conv_id", "turn", valid.alias("valid")), "conv_id", "turn", F.col("valid"))


QUERIES = {f.__name__: f for f in (f1_normalize_text, f3_normalize_date, s21_date_formats, f4_normalize_amount, f6_tax_id_checksum, f7_invoice_number, f9_fuzzy_score, a1_field_scores, a3_config_summary, a11_challenge_pivot, a11_items_f1, t9_item_alignment, a2_item_prf, a3_item_means, a5_latency_cold_warm, a6_api_cost, a7_gpu_cost, a8_cost_branch, a9_field_consistency, a10_stability, a21_parse_timing, a22_usage_totals, t10_first_valid_attempt)}

_E = "e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS tokens FROM events)"
_PRICES = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in PRICES.items()) + ") AS r(event_type, rate_in, rate_out)"
_USAGE = f"{_E}, m AS (SELECT event_type, avg(tokens) AS t_in, avg(tokens * 2) AS t_out, avg(value) AS gpu FROM e GROUP BY 1), u AS (SELECT * FROM m LEFT JOIN {_PRICES} USING (event_type))"
_API, _GPU = "100 * (t_in / 1e6 * rate_in + t_out / 1e6 * rate_out)", f"gpu / 3600 * {GPU_HOUR} * 100"
_RUNS = """
x AS (SELECT l_orderkey, CASE WHEN l_suppkey % 5 <> 0 THEN l_returnflag END AS a, l_linestatus AS b, l_quantity::BIGINT AS c, l_partkey % 6 <> 0 AS ok FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n_runs, count(*) FILTER (ok) AS n_valid FROM x GROUP BY 1),
v AS (SELECT l_orderkey, 1 AS f, a::VARCHAR AS v FROM x WHERE ok UNION ALL SELECT l_orderkey, 2, b FROM x WHERE ok UNION ALL SELECT l_orderkey, 3, c::VARCHAR FROM x WHERE ok),
k AS (SELECT l_orderkey, f, v, count(*) AS c FROM v GROUP BY ALL), z AS (SELECT l_orderkey, f, round(max(c) / sum(c), 6)::DOUBLE AS s FROM k GROUP BY ALL),
y AS (SELECT l_orderkey, max(s) FILTER (f = 1) AS l_returnflag, max(s) FILTER (f = 2) AS l_linestatus, max(s) FILTER (f = 3) AS l_quantity FROM z GROUP BY 1)
"""
ORACLES = {
    "f1_normalize_text": r"SELECT c_custkey AS key, upper(trim(regexp_replace('  ' || replace(c_name, '#', '  # ') || ' x1 fi2 ', '\s+', ' ', 'g'))) AS norm FROM customer",
    "f3_normalize_date": """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 6 AS k, o_orderdate AS t FROM orders)
        SELECT key, CASE k WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN '中華民國' || (year(t) - 1911) || '年' || strftime(t, '%m') || '月' || strftime(t, '%d') || '日' WHEN 2 THEN strftime(t, '%d/%m/%Y')
        WHEN 3 THEN strftime(t, '%Y%m%d') WHEN 4 THEN lpad((year(t) - 1911)::VARCHAR, 3, '0') || strftime(t, '%m%d') ELSE strftime(t, '%Y') || '-13-' || strftime(t, '%d') END AS raw,
        CASE WHEN k < 5 THEN strftime(t, '%Y-%m-%d') END AS iso FROM o""".replace("SELECT key, CASE k", "SELECT key, CASE WHEN key % 4 = 1 THEN translate(r, $WIDE) ELSE r END AS raw, iso FROM (SELECT key, CASE k").replace("AS raw,\n", "AS r,\n").replace("AS iso FROM o", "AS iso FROM o)").replace("$WIDE", ", ".join(f"'{x}'" for x in WIDE)),
    "s21_date_formats": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "f4_normalize_amount": """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 5 AS k, floor(o_totalprice * 100)::BIGINT AS c FROM orders), p AS (SELECT *, c // 100 AS w, lpad((c % 100)::VARCHAR, 2, '0') AS r FROM o)
        SELECT key, CASE k WHEN 0 THEN 'NT$' || format('{:,}', w) || '.' || r WHEN 1 THEN 'RM ' || w || '.' || r WHEN 2 THEN '-' || w WHEN 3 THEN w || ' 元' ELSE 'n/a' END AS raw,
        CASE WHEN k < 2 THEN (w || '.' || r)::DOUBLE WHEN k = 2 THEN -w::DOUBLE WHEN k = 3 THEN w::DOUBLE END AS amount FROM p""".replace("SELECT key, CASE k", "SELECT key, CASE WHEN key % 4 = 1 THEN translate(t, $WIDE) WHEN key % 4 = 2 THEN chr(9) || t || chr(10) ELSE t END AS raw, amount FROM (SELECT key, CASE k").replace("END AS raw,\n", "END AS t,\n").replace("AS amount FROM p", "AS amount FROM p)").replace("$WIDE", ", ".join(f"'{x}'" for x in WIDE)),
    "f6_tax_id_checksum": """WITH k AS (SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey + 1000000 FROM supplier), t AS (SELECT key, lpad((key * 7919 % 100000000)::VARCHAR, 8, '0') AS tax_id FROM k),
        p AS (SELECT key, tax_id, unnest([substring(tax_id, i, 1)::INT * [1, 2, 1, 2, 1, 2, 4, 1][i] FOR i IN range(1, 9)]) AS p FROM t),
        s AS (SELECT key, tax_id, sum(p // 10 + p % 10) AS s FROM p GROUP BY ALL) SELECT key, tax_id, s % 5 = 0 OR (substring(tax_id, 7, 1) = '7' AND (s + 1) % 5 = 0) AS valid FROM s""",
    "f7_invoice_number": "SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 'XY' || lpad(o_orderkey::VARCHAR, 8, '0') ELSE 'AB' || lpad(o_orderkey::VARCHAR, 8, '0') END AS invoice_number FROM orders",
    "f9_fuzzy_score": f"""WITH x AS (SELECT p_partkey, p_name AS g, {PERTURBED_SQL.format(k='(p_partkey % 6)')} AS p FROM part),
        s AS (SELECT p_partkey, CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE 1 - levenshtein(g, p)::DOUBLE / greatest(length(g), length(p)) END AS s FROM x) SELECT p_partkey, round(s, 6) AS score, s >= 0.8 AS is_match FROM s""",
    "a1_field_scores": f"WITH {RECEIPTS_SQL} SELECT o_orderkey, field, exact, fuzzy, score FROM a",
    "a3_config_summary": f"WITH {RECEIPTS_SQL} SELECT config::INTEGER AS config, count(*) FILTER (field = 'seller_name') AS n, "
    + ", ".join(f"round(avg({m}::INT) FILTER (field = '{f}'), 6) AS {m}_{f}" for f in FIELDS for m in ("exact", "fuzzy"))
    + " FROM a GROUP BY 1",
    "a11_challenge_pivot": f"WITH {RECEIPTS_SQL}, m AS (SELECT o_orderkey, config, challenge, avg(exact::INT) AS m FROM a GROUP BY ALL) SELECT config::INTEGER AS config, "
    + ", ".join(f"round(avg(m) FILTER (challenge = {v}), 6) AS challenge_{v}" for v in range(7))
    + " FROM m GROUP BY 1",
    "t9_item_alignment": f"WITH RECURSIVE {ITEMS_SQL} SELECT o_orderkey, gt_idx, pred_idx, round(sim, 6) AS sim, amount_exact FROM m",
    "a2_item_prf": f"""WITH RECURSIVE {ITEMS_SQL}, k AS (SELECT o_orderkey, (count(*) FILTER (gt_idx IS NOT NULL AND pred_idx IS NOT NULL))::DOUBLE AS tp, count(*) FILTER (gt_idx IS NULL) AS fp, count(*) FILTER (pred_idx IS NULL) AS fn,
        count(*) FILTER (amount_exact AND gt_idx IS NOT NULL AND pred_idx IS NOT NULL) AS same, count(*) FILTER (sim = 1.0) AS names, sum(sim) FILTER (gt_idx IS NOT NULL AND pred_idx IS NOT NULL) AS alike FROM m GROUP BY 1),
        d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0::DOUBLE END AS r FROM k)
        SELECT o_orderkey, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 6) AS f1,
        round(CASE WHEN tp > 0 THEN same / tp END, 6) AS amount_accuracy, round(CASE WHEN tp > 0 THEN names / tp END, 6) AS name_exact_rate, round(CASE WHEN tp > 0 THEN alike / tp END, 6) AS name_avg_similarity FROM d""",
    "a5_latency_cold_warm": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1 AS cold FROM events)
        SELECT event_type, cold, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM f GROUP BY ALL""",
    "a6_api_cost": f"WITH {_USAGE} SELECT event_type, round({_API}, 6) AS usd_per_100 FROM u",
    "a7_gpu_cost": f"WITH {_USAGE} SELECT event_type, round({_GPU}, 6) AS usd_per_100 FROM u",
    "a8_cost_branch": f"WITH {_USAGE} SELECT event_type, round(CASE WHEN event_type NOT IN ('click', 'view') THEN {_API} ELSE {_GPU} END, 6) AS usd_per_100 FROM u",
    "a9_field_consistency": f"WITH {_RUNS} SELECT l_orderkey, l_returnflag FROM n LEFT JOIN y USING (l_orderkey)",
    "a10_stability": f"WITH {_RUNS} SELECT l_orderkey, n_runs, n_valid, round(n_valid / n_runs, 6) AS validity_rate, l_returnflag, l_linestatus, l_quantity FROM n LEFT JOIN y USING (l_orderkey)",
    "a21_parse_timing": f"WITH {_E} SELECT user_id, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS median, round(count(*) FILTER (value > 0) / sum(value) FILTER (value > 0), 6) AS rate FROM e GROUP BY 1",
    "a22_usage_totals": f"WITH {_E} SELECT event_type, count(*) AS calls, coalesce(sum(tokens) FILTER (user_id % 3 <> 0), 0) AS tokens, coalesce(bool_or(user_id % 3 <> 0 AND tokens IS NOT NULL), false) AS reported FROM e GROUP BY 1",
    "t10_first_valid_attempt": """WITH c AS (SELECT conv_id, turn, turn % 3 = 2 AND role <> 'user' AS valid FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (valid) AS first FROM c GROUP BY 1)
        SELECT conv_id, count(*) FILTER (first IS NULL OR turn <= first) AS attempts, first IS NOT NULL AS is_valid FROM c JOIN f USING (conv_id) GROUP BY conv_id, first""",
}
ORACLES["a11_items_f1"] = (
    "SELECT (o_orderkey % 3)::INTEGER AS config, "
    + ", ".join(f"round(avg(f1) FILTER (o_orderkey % 7 = {v}), 6) AS challenge_{v}" for v in range(7))
    + f" FROM ({ORACLES['a2_item_prf']}) AS s GROUP BY 1"
)
ORACLES["a3_item_means"] = (
    "SELECT (o_orderkey % 4)::INTEGER AS config, "
    + ", ".join(f"round(avg({m}) FILTER (o_orderkey % 4 <> 3), 6) AS items_{m}" for m in ("precision", "recall", "f1", "amount_accuracy", "name_exact_rate", "name_avg_similarity"))
    + f" FROM ({ORACLES['a2_item_prf']}) AS s GROUP BY 1"
)
