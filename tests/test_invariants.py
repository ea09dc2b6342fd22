"""Null semantics against a plain model, and lineage that adds up to the figures it explains."""
import math
import random

from pyspark.sql import functions as F

from rowproof.operators import Agg, aggregate, dedupe, enrich, expand, filter_rows
from rowproof.operators.aggregate import list_rows
from rowproof.provenance import publish_with
from rowproof.provenance.citations import CLAIMS

OPS = [Agg("n", "count"), Agg("total", "sum", "v"), Agg("avg", "mean", "v"), Agg("lo", "min", "v"), Agg("hi", "max", "v"),
       Agg("kinds", "count_distinct", "v"), Agg("one", "first", "v"), Agg("head", "first_including_null", "v"),
       Agg("every", "list", "v"), Agg("big", "count", where="v > 2"), Agg("big_sum", "sum", "v", "v > 2"),
       Agg("odd", "sum", "v", "w != 1"), Agg("odd_list", "list", "v", "w != 1"), Agg("void", "max", "v", "w IS NULL AND v > 3")]


def gone(x):
    return x is None or (isinstance(x, float) and math.isnan(x))


def figure(op, rows):
    tests = {None: lambda v, w: True, "v > 2": lambda v, w: not gone(v) and v > 2, "w != 1": lambda v, w: gone(w) or w != 1,
             "w IS NULL AND v > 3": lambda v, w: w is None and not gone(v) and v > 3}
    kept = [v for v, w in rows if tests[op.where](v, w)]
    present = [v for v in kept if not gone(v)]
    if not kept:
        return None
    return {"count": len(kept), "sum": sum(present), "mean": sum(present) / len(present) if present else None,
            "min": min(present, default=None), "max": max(present, default=None), "count_distinct": len(set(present)),
            "first": present[0] if present else None, "first_including_null": None if gone(kept[0]) else kept[0],
            "list": [None if gone(v) else v for v in kept]}[op.formula]


def test_aggregates_match_a_plain_model(spark):
    rng = random.Random(17)
    rows = [(rng.choice(["a", "b", "c", None, "d"] + [f"g{i}" for i in range(30)]), rng.choice([None, float("nan"), 1.0, 2.0, 3.0, 4.0]),
             rng.choice([None, 1, 2])) for _ in range(400)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, v double, w bigint, _ord bigint").repartition(5)
    groups = {}
    for g, v, w in rows:
        groups.setdefault(g, []).append((v, w))
    got = {r.g: r for r in aggregate(df, ["g"], OPS).rows.collect()}
    assert set(got) == set(groups)
    for g, held in groups.items():
        for op in OPS:
            want = figure(op, held)
            have = got[g][op.output]
            assert have == want or (isinstance(want, float) and math.isclose(have, want)), (g, op, have, want)
    whole = aggregate(df, [], OPS).rows.first()
    for op in OPS:
        want = figure(op, [(v, w) for _, v, w in rows])
        assert whole[op.output] == want or math.isclose(whole[op.output], want)
    long = {}
    for r in list_rows(df, ["g"], Agg("v", "list", "v", "w != 1")).orderBy("g", "position").collect():
        long.setdefault(r.g, []).append(r.v)
        assert r.position == len(long[r.g]) - 1
    assert long == {g: figure(OPS[12], held) for g, held in groups.items() if figure(OPS[12], held)}
    assert list_rows(df, [], Agg("v", "list", "v")).count() == 400


def test_contributions_reproduce_the_figures(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("abc"), rng.randint(0, 9), i) for i in range(300)], "g string, v bigint, _ord bigint").repartition(4)
    step = aggregate(df, ["g"], [Agg("total", "sum", "v"), Agg("big", "sum", "v", "v > 5")])
    fed = step.edges("t", "s").join(df.withColumnRenamed("_ord", "parent_ord"), "parent_ord")
    for column in ("total", "big"):
        summed = {r.ord: r.s for r in fed.where(F.array_contains("columns", column)).groupBy("ord").agg(F.sum("v").alias("s")).collect()}
        assert summed == {r["_ord"]: r[column] for r in step.output().collect() if r[column] is not None}


def test_every_row_has_a_followed_parent(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice([None, 1, 2, 3]), i) for i in range(200)], "k bigint, _ord bigint").repartition(4)
    ref = spark.createDataFrame([(k, f"z{k}", i) for i, k in enumerate([1, 2, None])], "k bigint, z string, _ord bigint")
    many = spark.createDataFrame([(rng.choice([1, 2, None]), i, i) for i in range(20)], "k bigint, m bigint, _ord bigint")
    for step, parents in ((filter_rows(df, "k > 1"), ["p"]), (dedupe(df, ["k"]), ["p"]), (enrich(df, ref, ["k"], {"z": "z"}), ["p", "r"]),
                          (expand(df, many, ["k"], {"m": "m"}), ["p", "r"])):
        out = step.output()
        n = out.count()
        assert [r[0] for r in out.select("_ord").orderBy("_ord").collect()] == list(range(n))
        direct = step.edges("x", *parents).where("kind = 'direct' AND parent_stage = 'p'")
        assert direct.count() == n == direct.select("ord").distinct().count()
        assert direct.join(df.select(F.col("_ord").alias("parent_ord")), "parent_ord", "left_anti").isEmpty()
    lost = dedupe(df, ["k"]).edges("x", "p")
    assert lost.count() == 200


def test_published_code_cites_what_it_shows(spark, numbered, tmp_path):
    df = numbered([("a", 1), ("b", 2)], "s string, n bigint")

    def write(table, output_dir, citations):
        citations.cite(spark.createDataFrame([("t", 1, "n", "2", "second"), ("t", 0, None, None, "row")], CLAIMS))
        table.drop("_ord").write.csv(output_dir)
        return table

    made, said = publish_with(write, {"t": df}, str(tmp_path / "out"))
    assert made.count() == 2 and {r.status for r in said.collect()} == {"ok"} and (tmp_path / "out").exists()
    assert publish_with(lambda t, output_dir, citations: t, {"t": df}, "x")[1] is None
