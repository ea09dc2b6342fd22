"""Cases of steps that change the grain: every case is aggregated, deduped and ranked by itself, all in one run."""
import pytest
from pyspark.sql import functions as F

from rowproof.errors import ContractError
from rowproof.operators import Agg, aggregate, dedupe, sort_rank
from rowproof.operators.reshape import SortKey
from rowproof.quality.scoring import run_cases

ROWS = [("a", "x", 1, 0), ("a", "x", 5, 1), ("a", "y", 2, 2), ("b", "x", 7, 3), ("b", None, 1, 4), ("b", None, 9, 5), (None, "x", 4, 6)]


@pytest.fixture
def inputs(spark):
    return spark.createDataFrame(ROWS, "case_id string, k string, n int, _ord bigint")


def verdicts(make, inputs, expected, columns):
    return {r.case_id: r.status for r in run_cases(make, {"in": inputs}, expected, columns).collect() if r.case_id}


def test_aggregate_cases(spark, inputs):
    ops = [Agg("total", "sum", "n"), Agg("big", "count", where="n > 4")]
    expected = spark.createDataFrame(
        [("a", "x", 6, 1), ("a", "y", 2, None), ("b", "x", 7, 1), ("b", None, 10, 1)], "case_id string, k string, total bigint, big bigint")
    make = lambda d: aggregate(d, ["k"], ops, within=["case_id"]).rows
    assert verdicts(make, inputs, expected, ["k", "total", "big"]) == {"a": "passed", "b": "passed"}
    wrong = expected.withColumn("total", F.when(F.col("case_id") == "b", F.col("total") + 1).otherwise(F.col("total")))
    assert verdicts(make, inputs, wrong, ["k", "total", "big"]) == {"a": "passed", "b": "mismatch"}


def test_whole_table_figures_of_each_case(inputs):
    got = aggregate(inputs, [], [Agg("big", "count", where="n > 6")], within=["case_id"]).rows.collect()
    # Case a admits no row and still has its one row.
    assert {(r.case_id, r.big) for r in got} == {("a", None), ("b", 2), (None, None)}


def test_dedupe_cases(spark, inputs):
    expected = spark.createDataFrame([("a", "x", 5), ("a", "y", 2), ("b", "x", 7), ("b", None, 9)], "case_id string, k string, n int")
    make = lambda d: dedupe(d, ["k"], "highest", "n", within=["case_id"]).rows
    assert verdicts(make, inputs, expected, ["k", "n"]) == {"a": "passed", "b": "passed"}


def test_rank_cases(inputs):
    got = sort_rank(inputs, [SortKey("n", descending=True, nulls="last")], "place", within=["case_id"])
    assert sorted((str(r.case_id), r.place, r.n) for r in got.rows.collect()) == [
        ("None", 1, 4), ("a", 1, 5), ("a", 2, 2), ("a", 3, 1), ("b", 1, 9), ("b", 2, 7), ("b", 3, 1)]
    with pytest.raises(ContractError):
        sort_rank(inputs, [SortKey("n", nulls="last")], "place", within=["absent"])
