"""Means of item scores by configuration."""

from spandrel.operators import receipts as O


def test_records_without_a_match_have_no_shares(spark):
    rows = [("a", 0, None, 0.0, False), ("b", 0, 0, 0.75, True), ("b", 1, 1, 1.0, False), ("b", None, 2, 0.0, False)]
    got = {r.k: r for r in O.item_scores(spark.createDataFrame(rows, "k string, gt_idx int, pred_idx int, sim double, amount_exact boolean"), "k").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].amount_accuracy, got["a"].name_exact_rate, got["a"].name_avg_similarity) == (1.0, 0.0, None, None, None)
    assert (got["b"].amount_accuracy, got["b"].name_exact_rate, got["b"].name_avg_similarity, got["b"].f1) == (0.5, 0.5, 0.875, 0.8)


def test_item_summary(spark):
    rows = [("a", 1.0, 0.5, 0.6, 1.0, None, None, True), ("a", 0.0, 1.0, 0.0, 0.5, 0.25, 0.8, True), ("b", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, False)]
    scores = spark.createDataFrame(rows, "config string, precision double, recall double, f1 double, amount_accuracy double, name_exact_rate double, name_avg_similarity double, measured boolean")
    got = {r[0]: tuple(r)[1:] for r in O.item_summary(scores, "config", "measured").collect()}
    assert got == {"a": (0.5, 0.75, 0.3, 0.75, 0.25, 0.8), "b": (None,) * 6}
    assert O.item_summary(scores.limit(0), "config", "measured").collect() == []
