"""Plan properties that decide how the operators behave on large tables."""
import re

import pytest
from pyspark.sql import functions as F

from rowproof.operators import Agg, aggregate, dedupe, enrich, extend, filter_rows, narrow
from rowproof.operators.join import key_coverage
from rowproof.quality import profile
from rowproof.sources import read_parquet

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def orders(spark):
    return read_parquet(spark, f"{FOLDER}/orders.parquet")


def test_filters_and_columns_reach_the_scan(orders):
    kept = filter_rows(orders, "o_totalprice > 1000 AND o_orderstatus != 'F' AND NOT o_custkey < 5")
    scan = re.search(r"PushedFilters: .*", formatted(kept.rows.select("o_orderkey"))).group()
    assert "GreaterThan(o_totalprice,1000.0)" in scan
    only = formatted(narrow(orders, ["o_orderkey"]).select("o_orderkey"))
    assert "ReadSchema: struct<o_orderkey:bigint" in only and "o_totalprice" not in only.split("ReadSchema")[1]


def test_where_of_every_figure_reaches_the_scan(orders):
    made = aggregate(orders, ["o_custkey"], [Agg("n", "count", where="o_totalprice > 490000"),
                                            Agg("m", "max", "o_totalprice", "o_orderstatus == 'F'")])
    assert "PushedFilters: [Or(" in formatted(made.rows)


def test_aggregate_is_one_shuffle_with_partials(orders):
    made = aggregate(orders, ["o_orderpriority"], [Agg("n", "count"), Agg("big", "count", where="o_totalprice > 5"),
                                                   Agg("s", "sum", "o_totalprice"), Agg("a", "mean", "o_totalprice")])
    text = plan(made.rows)
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text and "Window" not in text


def test_dedupe_limits_each_group_before_the_shuffle(orders):
    text = plan(dedupe(orders, ["o_orderpriority"], "highest", "o_totalprice").rows)
    assert re.search(r"Exchange hashpartitioning.*\n.*WindowGroupLimit.*Partial", text)


def test_projections_do_not_shuffle(orders):
    assert "Exchange" not in plan(extend(orders, {"x": "o_totalprice * 2"}).rows)


def test_profile_and_coverage_group_once(orders, spark):
    profiled = profile(orders, ["o_orderstatus", "o_orderpriority"], 3)
    profiled.collect()
    # All figures come from the counts that were written; the table itself is not read again.
    assert "orders.parquet" not in plan(profiled)
    lines = read_parquet(spark, f"{FOLDER}/lineitem.parquet", ordinals=False)
    covered = key_coverage(lines, orders, [("l_orderkey", "o_orderkey")])
    covered.collect()
    assert "ReusedExchange" in plan(covered)


def test_hot_null_safe_join_keys_are_split(spark):
    """A third of the subject shares one absent key; the join still spreads over tasks."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
               "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50000)
        subject = spark.range(600000).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("v"),
                                             F.col("id").alias("_ord")).repartition(8)
        named = spark.range(50000).select(F.col("id").alias("k"), F.col("id").alias("z"), F.col("id").alias("_ord"))
        named = named.unionByName(spark.sql("SELECT cast(null AS bigint) k, -1L z, 50000L _ord"))
        made = enrich(subject, named, ["k"], {"z": "z"}).rows.groupBy("z").agg(
            F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
        assert {r.z: r.n for r in made.collect()}[-1] == 200000
        assert "SortMergeJoin(skew=true)" in plan(made)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
