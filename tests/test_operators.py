import random

import pytest
from pyspark.sql import functions as F

from rowproof.errors import CardinalityError, ContractError, StepRefused
from rowproof.operators import (
    Agg, SortKey, aggregate, check_writes, dedupe, enrich, expand, explode_rows, extend, filter_rows,
    key_coverage, map_frames, map_rows, narrow, read_cell, refuse_where, replace, row_errors, rows_at,
    rule_branches, search_rows, sort_rank, trim, union, window)
from rowproof.operators.aggregate import output_table
from rowproof.operators.filter import rows_listed
from rowproof.operators.join import align, coverage_warnings
from rowproof.operators.project import branch_coverage, failure_kind
from rowproof.ordinals import number_kept
from rowproof.schema import Col, Table

FILINGS = [("F-1001", "Northwind Resources", 120000, "T2", ["TAX", "ENERGY"]),
           ("F-1002", "Cascade Freight", 45000, "T1", ["TRANSPORT"]),
           ("F-1003", "Northwind Resources", 260000, "T1", [])]
FILINGS_DDL = "filing_id string, client string, amount_usd bigint, tier string, issues array<string>"
FIRMS = [("a", 10), (None, 20), ("a", 30), ("b", 40), ("b", 50)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def placed(step):
    return rows(step.output().orderBy("_ord"))


def parents(step, stage, *stages):
    return sorted((r.ord, r.parent_stage, r.parent_ord, r.kind, tuple(r.columns or ()))
                  for r in step.edges(stage, *stages).collect())


# ── explode, dedupe, sort ──


def test_explode_drops_or_keeps_empty(numbered):
    df = numbered(FILINGS, FILINGS_DDL)
    step = explode_rows(df, "issues")
    assert [(r[0], r[4], r[5]) for r in placed(step)] == [
        ("F-1001", "TAX", 0), ("F-1001", "ENERGY", 1), ("F-1002", "TRANSPORT", 2)]
    assert parents(step, "x", "src") == [
        (0, "src", 0, "direct", ()), (1, "src", 0, "direct", ()), (2, "src", 1, "direct", ())]
    kept = explode_rows(df, "issues", keep_empty=True)
    assert [(r[0], r[4]) for r in placed(kept)][-1] == ("F-1003", None)
    assert step.rows.columns == df.columns[:-1]
    with pytest.raises(ContractError):
        explode_rows(df, "client")


def test_dedupe(numbered):
    df = numbered(FILINGS, FILINGS_DDL)
    first = dedupe(df, ["client"])
    assert [r[0] for r in placed(first)] == ["F-1001", "F-1002"]
    high = dedupe(df, ["client"], "highest", "amount_usd")
    assert [r[0] for r in placed(high)] == ["F-1003", "F-1002"]
    assert parents(high, "d", "src") == [
        (0, "src", 0, "contribution", ()), (0, "src", 2, "direct", ()), (1, "src", 1, "direct", ())]
    low = dedupe(df, ["client"], "lowest", "amount_usd")
    assert [r[0] for r in placed(low)] == ["F-1002", "F-1001"]
    nulls = numbered([(None, 1), (None, 2), ("k", 3)], "k string, v bigint")
    assert [r[1] for r in placed(dedupe(nulls, ["k"]))] == [1, 3]
    with pytest.raises(ContractError):
        dedupe(df, ["client"], "highest")


def test_sort_rank(numbered):
    df = numbered(FILINGS, FILINGS_DDL)
    step = sort_rank(df, [SortKey("tier", order=["T2", "T1"]), SortKey("amount_usd", descending=True)], "rank")
    assert [(r[0], r[-2], r[-1]) for r in placed(step)] == [
        ("F-1001", 1, 0), ("F-1003", 2, 1), ("F-1002", 3, 2)]
    assert parents(step, "s", "src") == [
        (0, "src", 0, "direct", ()), (1, "src", 2, "direct", ()), (2, "src", 1, "direct", ())]
    with pytest.raises(StepRefused, match="T2"):
        sort_rank(df, [SortKey("tier", order=["T1"])])
    with pytest.raises(ContractError):
        SortKey("tier", order=["T1"], descending=True)
    with pytest.raises(ContractError, match="nullable"):
        sort_rank(df, [SortKey("tier")], contract=Table.of(Col("tier", "str")))


def test_sort_places_nulls_and_is_stable(numbered):
    df = numbered([(2, "a"), (None, "b"), (1, "c"), (2, "d"), (None, "e")], "n bigint, s string")
    def order(**kw):
        return [r[1] for r in placed(sort_rank(df, [SortKey("n", **kw)]))]
    assert order(nulls="first") == ["b", "e", "c", "a", "d"]
    assert order(nulls="last") == ["c", "a", "d", "b", "e"]
    assert order(descending=True, nulls="last") == ["a", "d", "c", "b", "e"]
    assert order(descending=True, nulls="first") == ["b", "e", "a", "d", "c"]


def test_dense_numbering_over_many_partitions(spark):
    rng = random.Random(3)
    values = [rng.choice([7] * 5 + list(range(20))) for _ in range(3000)]  # one hot value
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v bigint, _ord bigint").repartition(7)
    got = placed(sort_rank(df, [SortKey("v")], "rank"))
    want = sorted(enumerate(values), key=lambda p: (p[1], p[0]))
    assert [(r[0], r[1]) for r in got] == [(v, i + 1) for i, (_, v) in enumerate(want)]
    kept = number_kept(df.where("v = 7"), into="at", block=64).orderBy("_ord").collect()
    assert [r["at"] for r in kept] == list(range(len(kept))) and len(kept) == values.count(7)


# ── filter, window, reads ──


def test_filter_keeps_order_and_lineage(numbered):
    df = numbered([("x", 1), ("y", -1), ("z", 2)], "a string, b bigint")
    for keep in ("b > 0", F.col("b") > 0, lambda row: row["b"] > 0):
        step = filter_rows(df, keep)
        assert placed(step) == [("x", 1, 0), ("z", 2, 1)]
        assert parents(step, "f", "src") == [(0, "src", 0, "direct", ()), (1, "src", 2, "direct", ())]
    with pytest.raises(Exception, match="not a bool"):
        filter_rows(df, lambda row: "yes").rows.collect()


def test_search_and_reads(numbered):
    df = numbered([(f"r{i}", i) for i in range(50)], "a string, b bigint")
    found = search_rows(df, "b >= 10", limit=99)
    assert (found.matched, found.scanned) == (40, 50)
    assert [r["_ord"] for r in found.rows.collect()] == list(range(10, 50))
    assert [r["a"] for r in rows_at(df, [4, 2, 4]).collect()] == ["r2", "r4"]
    assert read_cell(df, 3, "a") == "r3"
    assert rows_listed(df, df.where("b < 3")).count() == 3
    with pytest.raises(IndexError):
        rows_at(df, [50])
    cut = window(df, 45, 10)
    assert [r["b"] for r in cut.frame.orderBy("_ord").collect()] == [45, 46, 47, 48, 49]
    assert cut.notes and not window(df).notes


# ── projections ──


def test_projections(numbered):
    df = numbered([("x", 1), ("y", None)], "a string, b bigint")
    step = extend(df, {"c": "b * 2"}, {"b": F.coalesce("b", F.lit(0))})
    assert step.rows.columns == ["a", "b", "c"] and rows(step.rows) == [("x", 1, 2), ("y", 0, None)]
    assert replace(df, {"z": "upper(a)"}).rows.columns == ["z"]
    assert narrow(df, ["b"]).columns == ["b", "_ord"]
    for bad in ({"adds": {"a": "b"}}, {"rewrites": {"q": "b"}}, {"adds": {"_x": "b"}}):
        with pytest.raises(ContractError):
            extend(df, **bad)
    declared, dropped = trim(step.frame, Table.of(Col("a", "str"), Col("c", "int")))
    assert declared.columns == ["a", "c", "_ord"] and dropped == ["b"]
    with pytest.raises(ContractError):
        trim(df, Table.of(Col("nope", "str")))


def test_row_code(numbered):
    df = numbered([("$1,200", 1), ("", 2), (None, 3)], "money string, k bigint")

    def read_money(row):
        text = (row["money"] or "").replace("$", "").replace(",", "")
        return {"usd": int(text) if text else 0}

    step = map_rows(df, read_money, Table.of(Col("usd", "int")))
    assert step.rows.columns == ["money", "k", "usd"]
    assert [r["usd"] for r in step.frame.orderBy("_ord").collect()] == [1200, 0, 0]
    with pytest.raises(Exception, match="not a mapping"):
        map_rows(df, lambda row: 3, Table.of(Col("usd", "int"))).rows.collect()
    assert map_frames(lambda a, b: a.unionByName(b), df, df).count() == 6
    with pytest.raises(TypeError):
        map_frames(lambda a: 3, df)


def test_row_code_sees_plain_values_and_spoils_none(numbered):
    big = 2 ** 60 + 1
    df = numbered([(big, 1.5, ["a"]), (None, float("nan"), None)], "n bigint, f double, l array<string>")
    seen = map_rows(df, lambda row: {"said": repr((row["n"], row["f"], row["l"]))}, Table.of(Col("said", "str")))
    got = seen.frame.orderBy("_ord").collect()
    assert [r.said for r in got] == [f"({big}, 1.5, ['a'])", "(None, None, None)"]
    assert [r.n for r in got] == [big, None]
    kept = filter_rows(df, lambda row: row["n"] == big)
    assert kept.rows.first().n == big and kept.rows.count() == 1


def test_refusal(numbered):
    df = numbered([("5", 1), ("-2", 2)], "money string, k bigint")
    refused = refuse_where(df, F.col("money").cast("int") < 0, F.concat(F.lit("negative: "), "money"), "money")
    with pytest.raises(Exception, match="refused: negative: -2") as caught:
        refused.select("money").collect()
    assert failure_kind(caught.value) == "refused"
    assert failure_kind(ContractError("x")) == "schema" and failure_kind(KeyError("x")) == "crash"


def test_row_checks(numbered):
    df = numbered([("a", 1, "7"), ("q", 99, "x"), (None, 2, None)], "s string, n bigint, t string")
    declared = Table.of(Col("s", "str", nullable=False, enum=("a", "b")), Col("n", "int", range=(0, 10)),
                        Col("t", "int"))
    checked = check_writes(df, declared)
    bad = {r["_ord"]: r["_error"] for r in row_errors(checked).collect()}
    assert set(bad) == {1, 2} and bad[1].count(";") == 2 and "required" in bad[2]


def test_branches(numbered):
    df = numbered([(1,), (5,), (None,)], "n bigint")
    rules = [("small", "n < 3"), ("big", "n >= 3"), ("any", "n IS NOT NULL"), ("never", "n == 77")]
    step = rule_branches(df, rules)
    assert [r["branches"] for r in step.frame.orderBy("_ord").collect()] == [["small", "any"], ["big", "any"], []]
    assert rows(branch_coverage(step.frame, rules)) == [("small", 1), ("big", 1), ("any", 2), ("never", 0)]


# ── joins ──


def test_enrich(numbered):
    subject = numbered([(30,), (10,), (20,), (10,)], "x int")
    reference = numbered([(10, "ten"), (20, "twenty"), (40, "forty")], "x int, z string")
    for verify in ("first", "in_plan"):
        step = enrich(subject, reference, ["x"], {"z": "word"}, verify=verify)
        assert placed(step) == [(30, None, 0), (10, "ten", 1), (20, "twenty", 2), (10, "ten", 3)]
        assert parents(step, "j", "s", "r") == [
            (0, "s", 0, "direct", ()), (1, "r", 0, "direct", ()), (1, "s", 1, "direct", ()),
            (2, "r", 1, "direct", ()), (2, "s", 2, "direct", ()), (3, "r", 0, "direct", ()),
            (3, "s", 3, "direct", ())]
    repeated = numbered([(10, "a"), (10, "b")], "x int, z string")
    with pytest.raises(CardinalityError, match="10"):
        enrich(subject, repeated, ["x"], {"z": "z"})
    with pytest.raises(Exception, match="repeats a key"):
        enrich(subject, repeated, ["x"], {"z": "z"}, verify="in_plan").rows.collect()
    for brings in ({"z": "x"}, {"z": "_z"}, {"q": "q"}):
        with pytest.raises(ContractError):
            enrich(subject, reference, ["x"], brings)


def test_null_keys(numbered):
    subject = numbered([(None,), (1,)], "x int")
    reference = numbered([(None, "none"), (1, "one")], "x int, z string")
    assert [r[1] for r in placed(enrich(subject, reference, ["x"], {"z": "z"}))] == ["none", "one"]
    plain = enrich(subject, reference, ["x"], {"z": "z"}, null_keys_match=False)
    assert [r[1] for r in placed(plain)] == [None, "one"]
    with pytest.raises(CardinalityError):
        enrich(subject, numbered([(None, "a"), (None, "b")], "x int, z string"), ["x"], {"z": "z"})


def test_expand_fans_out_in_order(numbered):
    subject = numbered([(1,), (2,), (1,)], "x int")
    reference = numbered([(1, "a"), (1, "b"), (3, "c")], "x int, z string")
    step = expand(subject, reference, ["x"], {"z": "z"})
    assert placed(step) == [(1, "a", 0), (1, "b", 1), (2, None, 2), (1, "a", 3), (1, "b", 4)]
    assert parents(step, "e", "s", "r")[:3] == [
        (0, "r", 0, "direct", ()), (0, "s", 0, "direct", ()), (1, "r", 1, "direct", ())]


def test_sliced_hot_keys_change_nothing(numbered):
    rng = random.Random(5)
    subject = numbered([(rng.choice([1, 1, 2, 3, None, 9]), i) for i in range(60)], "x int, s int")
    reference = numbered([(rng.choice([1, 1, 1, None, None, 2, 4]), i) for i in range(200)], "x int, r int")
    plain = expand(subject, reference, ["x"], {"r": "r"}, hot_rows=None)
    sliced = expand(subject, reference, ["x"], {"r": "r"}, hot_rows=20)
    assert sorted(map(repr, rows(plain.rows))) == sorted(map(repr, rows(sliced.rows)))
    assert plain.rows.count() > 1000
    assert placed(plain) == placed(sliced)
    # Tables without positions are cut as well, down to a slice per row; maps are carried, not hashed.
    bare, other = subject.drop("_ord"), reference.drop("_ord").withColumn("m", F.create_map(F.lit("k"), "r"))
    for cut in (1, 7):
        got = expand(bare, other, ["x"], {"r": "r", "m": "m"}, hot_rows=cut).rows
        assert sorted(map(repr, rows(got.drop("m")))) == sorted(map(repr, rows(plain.rows)))
        assert got.where("m['k'] <=> r").count() == got.count()
    strict = [expand(subject, reference, ["x"], {"r": "r"}, null_keys_match=False, hot_rows=n).rows for n in (None, 9)]
    assert sorted(map(repr, rows(strict[0]))) == sorted(map(repr, rows(strict[1])))


def test_slices_follow_the_rows_of_each_key(numbered):
    subject = numbered([(1,), (2,), (3,)], "x int")
    reference = numbered([(1, i) for i in range(90)] + [(2, i) for i in range(21)] + [(3, 0)], "x int, r int")
    step = expand(subject, reference, ["x"], {"r": "r"}, hot_rows=20)
    plan = step.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan
    assert "_slice" not in expand(subject, reference, ["x"], {"r": "r"}, hot_rows=90).rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.x, r.r) for r in step.rows.collect()) == sorted(
        [(1, i) for i in range(90)] + [(2, i) for i in range(21)] + [(3, 0)])
    with pytest.raises(ContractError):
        expand(subject, reference, ["x"], {"r": "r"}, hot_rows=0)


def test_key_coverage(numbered):
    subject = numbered([(f"S{i:02d}", "t") for i in range(5)] + [("GU", "t"), (None, "t")], "state string, k string")
    reference = numbered([(f"S{i:02d}", 1) for i in range(20)] + [(None, 1)], "st string, v int")
    got = {r.side: r for r in key_coverage(subject, reference, [("state", "st")]).collect()}
    assert (got["reference"].absent, got["reference"].total) == (15, 20)
    assert got["reference"].sample == [f"S{i:02d}" for i in range(5, 15)]
    assert (got["subject"].absent, got["subject"].total, got["subject"].sample) == (1, 6, ["GU"])
    said = coverage_warnings(key_coverage(subject, reference, [("state", "st")]), "subj", "ref")
    assert any("and 5 more" in line for line in said) and len(said) == 2
    pair = numbered([("a", 1)], "p string, q int")
    other = numbered([("a", 2)], "p string, q int")
    both = {r.side: r.sample for r in key_coverage(pair, other, ["p", "q"]).collect()}
    assert both == {"reference": ["(a, 2)"], "subject": ["(a, 1)"]}


def test_align(numbered):
    a, b = numbered([(1,), (2,)], "x int"), numbered([(3,), (4,)], "y int")
    assert sorted((r.x, r.y) for r in align(a, b).collect()) == [(1, 3), (2, 4)]
    from rowproof.errors import GrainError
    with pytest.raises(GrainError):
        align(a, numbered([(1,)], "z int"))
    with pytest.raises(Exception, match="refused: position [15] is in one table only"):
        align(a, b.withColumn("_ord", F.col("_ord") * 5)).select("x").collect()


# ── aggregate ──

ALL = [Agg("n", "count"), Agg("total", "sum", "amt"), Agg("avg", "mean", "amt"), Agg("lo", "min", "amt"),
       Agg("hi", "max", "amt"), Agg("kinds", "count_distinct", "amt"), Agg("one", "first", "amt"),
       Agg("head", "first_including_null", "amt"), Agg("every", "list", "amt")]


def test_aggregate_groups(numbered):
    df = numbered(FIRMS, "firm string, amt bigint")
    step = aggregate(df, ["firm"], ALL)
    assert placed(step) == [
        ("a", 2, 40, 20.0, 10, 30, 2, 10, 10, [10, 30], 0),
        ("b", 2, 90, 45.0, 40, 50, 2, 40, 40, [40, 50], 1),
        (None, 1, 20, 20.0, 20, 20, 1, 20, 20, [20], 2)]


def test_each_figure_has_its_own_where(numbered):
    df = numbered(FIRMS, "firm string, amt bigint")
    step = aggregate(df, ["firm"], [Agg("n", "count"), Agg("big", "count", where="amt > 25"),
                                    Agg("sum_big", "sum", "amt", "amt > 25")])
    assert placed(step) == [("a", 2, 1, 30, 0), ("b", 2, 2, 90, 1), (None, 1, None, None, 2)]
    only = aggregate(df, ["firm"], [Agg("big", "count", where="amt > 25")])
    assert placed(only) == [("a", 1, 0), ("b", 2, 1)]
    fed = parents(step, "agg", "src")
    assert (0, "src", 0, "contribution", ("n",)) in fed
    assert (0, "src", 2, "contribution", ("n", "big", "sum_big")) in fed
    assert (2, "src", 1, "contribution", ("n",)) in fed and len(fed) == 5


def test_whole_table_and_emptiness(numbered):
    df = numbered(FIRMS, "firm string, amt bigint")
    assert placed(aggregate(df, [], ALL)) == [(5, 150, 30.0, 10, 50, 5, 10, 10, [10, 20, 30, 40, 50], 0)]
    empty = df.where("false")
    assert placed(aggregate(empty, [], ALL)) == [(None,) * 9 + (0,)]
    assert rows(aggregate(empty, ["firm"], ALL).rows) == []
    assert aggregate(df, ["firm"], []).rows.count() == 0
    assert len(parents(aggregate(df, [], ALL), "agg", "src")) == 5


def test_null_values_in_figures(numbered):
    df = numbered([("a", None, None), ("a", None, None), ("b", 2.0, "x"), ("b", float("nan"), None),
                   ("b", 3.0, "y")], "g string, v double, s string")
    ops = [Agg("total", "sum", "v"), Agg("kinds", "count_distinct", "v"), Agg("avg", "mean", "v"),
           Agg("one", "first", "v"), Agg("head", "first_including_null", "v"), Agg("every", "list", "v"),
           Agg("text", "sum", "s")]
    assert placed(aggregate(df, ["g"], ops)) == [
        ("a", 0.0, 0, None, None, None, [None, None], "", 0),
        ("b", 5.0, 2, 2.5, 2.0, 2.0, [2.0, None, 3.0], "xy", 1)]


def test_aggregate_contract(numbered):
    df = numbered(FIRMS, "firm string, amt bigint")
    for ops in ([Agg("n", "median", "amt")], [Agg("n", "sum")], [Agg("n", "sum", "q")],
                [Agg("firm", "count")], [Agg("_n", "count")], [Agg("n", "mean", "firm")]):
        with pytest.raises(ContractError):
            aggregate(df, ["firm"], ops)
    source = Table.of(Col("firm", "str"), Col("amt", "int", nullable=False))
    made = output_table(source, ["firm"], ALL)
    assert [(c.name, c.type) for c in made.columns][1:4] == [("n", "int"), ("total", "int"), ("avg", "float")]
    assert made.get("every").type == "list[int]"


# ── union ──


def test_union(numbered):
    left = numbered([("l0", 1), ("l1", 2)], "a string, b int")
    right = numbered([("r0", 3), ("r1", 4), ("r2", 5)], "a string, b int")
    step = union(left, right)
    assert [r[0] for r in placed(step)] == ["l0", "l1", "r0", "r1", "r2"]
    assert parents(step, "u", "L", "R") == [
        (0, "L", 0, "direct", ()), (1, "L", 1, "direct", ()), (2, "R", 0, "direct", ()),
        (3, "R", 1, "direct", ()), (4, "R", 2, "direct", ())]
    wide = union(left, numbered([("w", 2.5)], "a string, b double"))
    assert wide.rows.schema["b"].dataType.simpleString() == "double"
    with pytest.raises(ContractError):
        union(left, numbered([("w", "text")], "a string, b string"))
    with pytest.raises(ContractError):
        union(left, numbered([("w",)], "a string"))
    with pytest.raises(ContractError):
        union(left, right, contracts=[Table.of(Col("a", "str")), Table.of(Col("a", "str", nullable=False))])


def test_row_code_faults_stay_on_their_row(numbered):
    df = numbered([(k, None) for k in range(8)] + [(8, "earlier")], "k bigint, _error string")
    made = {0: {"n": 3, "d": 1.5}, 1: {"n": 1.5, "d": 2}, 2: {"n": "x", "d": "y"}, 3: {"n": 2 ** 70, "d": None}, 4: {"n": 2.0, "d": True},
            5: {"d": 0.5}, 6: {"n": None, "d": float("inf"), "other": 1}, 7: {"n": [1], "d": {}}, 8: {"n": "z", "d": 1.0}}
    step = map_rows(df, lambda row: made[row["k"]], Table.of(Col("n", "int", nullable=False), Col("d", "float")))
    got = {r.k: (r.n, r.d, r["_error"]) for r in step.frame.collect()}
    assert got[0] == (3, 1.5, None) and got[1] == (None, 2.0, "n: 1.5 (float) is no int64") and got[6] == (None, float("inf"), None)
    assert got[2] == (None, None, "n: 'x' (str) is no int64; d: 'y' (str) is no double")
    assert got[3][0] is None and got[3][2].startswith("n: 1180591620717411303424 (int)") and got[4] == (2, None, "d: True (bool) is no double")
    assert got[5] == (None, 0.5, "n: not written") and got[7][2] == "n: [1] (list) is no int64; d: {} (dict) is no double"
    assert got[8] == (None, 1.0, "earlier; n: 'z' (str) is no int64")
    assert step.rows.columns == ["k", "n", "d"]
    with pytest.raises(Exception, match="broken code"):
        def broken(row):
            raise RuntimeError("broken code")
        map_rows(df, broken, Table.of(Col("n", "int"))).rows.collect()


def test_declared_types_of_written_columns(numbered):
    df = numbered([(1.0, 5, True, "2"), (1.5, None, False, "x"), (float("inf"), 7, None, None), (None, 8, True, "3.5")],
                  "d double, n bigint, b boolean, s string")
    def wrong(*columns):
        return [r["_error"] for r in check_writes(df, Table.of(*columns)).orderBy("_ord").collect()]
    assert wrong(Col("d", "int")) == [None, "d: 1.5 is not int", "d: Infinity is not int", None]
    assert wrong(Col("n", "float")) == [None] * 4 and wrong(Col("n", "int")) == [None] * 4
    assert wrong(Col("n", "str")) == ["n: 5 is not str", None, "n: 7 is not str", "n: 8 is not str"]
    assert wrong(Col("b", "int")) == ["b: true is not int", "b: false is not int", None, "b: true is not int"]
    assert wrong(Col("s", "int")) == [None, "s: x is not int", None, "s: 3.5 is not int"]


def test_union_of_inputs_that_lost_rows(numbered, spark):
    left = numbered([(f"l{i}",) for i in range(6)], "a string").where("a IN ('l0', 'l5')")
    right = numbered([(f"r{i}",) for i in range(4)], "a string").where("a <> 'r0'")
    none = left.where("a = 'no'")
    far = spark.createDataFrame([("f0", 3), ("f1", 1 << 40)], "a string, _ord bigint")
    step = union(left, none, right, far)
    assert [(r.a, r["_ord"]) for r in step.numbered().orderBy("_ord").collect()] == [
        (a, i) for i, a in enumerate(["l0", "l5", "r1", "r2", "r3", "f0", "f1"])]
    assert [(e[0], e[1], e[2]) for e in parents(step, "u", "L", "N", "R", "F")] == [
        (0, "L", 0), (1, "L", 5), (2, "R", 1), (3, "R", 2), (4, "R", 3), (5, "F", 3), (6, "F", 1 << 40)]
