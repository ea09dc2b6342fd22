import random
import statistics

import pytest
from pyspark.sql import functions as F

from rowproof.errors import ContractError
from rowproof.quality import check_counts, check_keys, output_shape, profile, rollup_issues, stage_status, validate
from rowproof.quality.validate import ISSUE_SCHEMA, issue_counts, merge_row_errors
from rowproof.schema import Col, Table


def said(report):
    return [(i.severity, i.column, i.message) for i in report.issues]


def test_clean_table(numbered):
    df = numbered([("a", 1)], "s string, n bigint")
    report = validate(df, Table.of(Col("s", "str", nullable=False), Col("n", "int")))
    assert report.ok and report.rows == 1 and said(report) == [] and stage_status(report) == "ok"


def test_every_check(numbered):
    df = numbered([("a", 1, 1.0, [1.0, None]), ("z", 20, 1.5, [2.5]), (None, None, float("nan"), None)],
                  "s string, n bigint, f double, l array<double>, ".rstrip(", "))
    schema = Table.of(Col("s", "str", nullable=False, enum=("a", "b")), Col("n", "int", range=(0, "+inf")),
                      Col("f", "int", nullable=False), Col("l", "list[int]"), Col("gone", "date"))
    found = {(c, m.split(", such as")[0].split(", among them")[0]) for s, c, m in said(validate(df, schema)) if s == "error"}
    assert found == {
        ("gone", "column 'gone' is not there"),
        ("s", "1 row(s) lack a value that must be there"),
        ("s", "1 value(s) not among ['a', 'b']"),
        ("f", "1 row(s) lack a value that must be there"),
        ("f", "1 value(s) do not read as 'int'"),
        ("l", "1 value(s) do not read as 'list[int]'")}
    tight = validate(df, Table.of(Col("n", "int", range=(2, 10))))
    assert ("error", "n", "2 value(s) beyond the bounds 2 and 10") in said(tight)
    assert any(s == "warning" and "3 column(s) that nothing declares" in m for s, _, m in said(tight))


def test_type_checks(numbered):
    df = numbered([(True, "x", 5)], "b boolean, t string, n bigint")
    kinds = validate(df, Table.of(Col("b", "int"), Col("t", "datetime"), Col("n", "float")))
    assert [c for _, c, _ in said(kinds)] == ["b", "t"]


def test_json_shapes(numbered):
    df = numbered([((1, "x"), {"k": "7"})], "j struct<a:bigint,extra:string>, m map<string,string>")
    fields = (Col("a", "str"), Col("b", "int"))
    report = validate(df, Table.of(Col("j", "json", fields=fields), Col("m", "json", value_type="int")))
    assert said(report) == [
        ("error", "j", "'a' inside is bigint where 'str' is declared"),
        ("error", "j", "the objects of this 'json' have no 'b'"),
        ("warning", "j", "1 field(s) inside that nothing declares: ['extra']")]
    bad = numbered([({"k": "7", "q": "x"},)], "m map<string,string>")
    assert "do not read as 'int'" in said(validate(bad, Table.of(Col("m", "json", value_type="int"))))[0][2]


def test_many_offenders_are_sampled_in_order(numbered):
    df = numbered([(f"v{i:02d}",) for i in range(30)], "s string")
    message = said(validate(df, Table.of(Col("s", "str", enum=("q",)))))[0][2]
    assert message.startswith("30 value(s) not among ['q'], such as 'v00', 'v01'") and message.endswith("…")
    counts = {(r.column, r.check): r.offenders for r in check_counts(df, Table.of(Col("s", "str", enum=("q",)))).collect()}
    assert counts == {("s", "enum"): 30}


def test_keys(numbered):
    orders = numbered([(1, "x"), (2, "y"), (2, "z")], "id bigint, c string")
    lines = numbered([(1, 1), (9, 1), (9, 2), (None, 1)], "oid bigint, n bigint")
    library = [Table((Col("id", "int"), Col("c", "str")), name="orders", primary_key=("id",)),
               Table((Col("oid", "int", references="orders.id"), Col("n", "int")), name="lines",
                     primary_key=("oid", "n"))]
    got = {(r.table, r.kind): r.offenders for r in check_keys({"orders": orders, "lines": lines}, library).collect()}
    assert got == {("orders", "primary_key"): 1, ("lines", "primary_key"): 0, ("lines", "foreign_key"): 2}
    with pytest.raises(ContractError):
        check_keys({"lines": lines}, [library[1]])


def test_rollup_and_status(spark, numbered):
    issues = spark.createDataFrame([
        ("s", "input", "warning", "a", "odd"), ("s", "output", "warning", "a", "odd"),
        ("s", "output", "error", None, "bad"), ("t", "output", "warning", "b", "odd")], ISSUE_SCHEMA)
    got = [(r.stage, r.severity, r.phases, r.raised) for r in rollup_issues(issues).collect()]
    assert got == [("s", "error", ["output"], 1), ("s", "warning", ["input", "output"], 2),
                   ("t", "warning", ["output"], 1)]
    assert {(r.stage, r.errors, r.warnings) for r in issue_counts(issues).collect()} == {("s", 1, 1), ("t", 0, 1)}
    df = numbered([("a", "boom"), ("b", None)], "s string, _error string")
    merged = merge_row_errors(validate(df, Table.of(Col("s", "str"))), df)
    assert not merged.ok and "1 row(s) failed: boom" in merged.issues[-1].message
    assert stage_status(merged) == "error"


def test_profile(numbered):
    df = numbered([("1", 2.0, True, [1]), ("2", 4.0, True, [1]), ("2", None, False, None), ("x", 9.0, None, [2])],
                  "t string, f double, b boolean, l array<int>")
    got = {r.column: r for r in profile(df, max_values=2).collect()}
    assert [(v["value"], v["count"]) for v in got["t"]["values"]] == [("2", 2), ("1", 1)]
    assert got["t"].truncated and got["t"].distinct_count == 3 and got["t"].min is None
    assert (got["f"].null_count, got["f"].min, got["f"].max, got["f"].mean, got["f"].median) == (1, 2.0, 9.0, 5.0, 4.0)
    assert got["b"].min is None and [v.value for v in got["b"]["values"]] == ["True", "False"]
    assert got["l"].distinct_count == 2 and got["l"]["values"][0].value == "[1]"
    numbers = numbered([("10",), ("2",), (None,)], "t string")
    row = profile(numbers).first()
    assert (row.min, row.max, row.mean, row.median) == (2.0, 10.0, 6.0, 6.0)
    empty = profile(df.where("false")).collect()
    assert [r.distinct_count for r in empty] == [0] * 4
    with pytest.raises(ContractError):
        profile(df, ["nope"])
    assert output_shape(df) == (4, 4)


def test_medians_and_commonest_values_are_exact(spark):
    rng = random.Random(11)
    a = [rng.gauss(0, 1e6) for _ in range(3001)]
    b = [float(rng.choice([5] * 6 + list(range(50)))) for _ in range(3000)] + [float("nan")]
    c = [rng.choice([1.0, 2.0]) for _ in range(1500)] + [None] * 1501
    df = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double")
    got = {r.column: r for r in profile(df, max_values=2000).collect()}
    assert {k: r.median for k, r in got.items()} == {"a": statistics.median(a), "b": statistics.median(b[:-1]),
                                                     "c": statistics.median([x for x in c if x is not None])}
    assert got["a"].truncated and len(got["a"]["values"]) == 2000 and got["b"].null_count == 1
    held = sorted(((b[:-1].count(x), str(x)) for x in set(b[:-1])), key=lambda v: (-v[0], v[1]))
    assert [(v["count"], v["value"]) for v in got["b"]["values"]] == held
    even = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (7.0,)], "x double")
    assert profile(even).first().median == 3.5 and profile(even, medians=False).first().median is None


def test_running_totals_over_cut_groups(spark):
    from rowproof.ordinals import running_totals
    rows = [(g, i, (i * 7) % 5) for g, n in (("big", 5000), ("small", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i bigint, w bigint").repartition(5)
    got = {(r.g, r.i): r.t for r in running_totals(df, "g", [F.desc("i")], "w", "t").collect()}
    want, held = {}, {}
    for g, i, w in sorted(rows, key=lambda r: -r[1]):
        want[g, i] = held.get(g, 0)
        held[g] = held.get(g, 0) + w
    assert got == want


def test_row_errors_beyond_the_listed_ones_are_counted(spark):
    from rowproof.quality.validate import SAMPLE, Report, merge_row_errors
    df = spark.createDataFrame([(f"e{i:02}",) for i in range(30)] + [("e00",), (None,)], "_error string")
    merged = merge_row_errors(Report("s", "p", 32, []), df)
    assert len(merged.issues) == SAMPLE + 1
    assert f"{30 - SAMPLE} further message(s) on {30 - SAMPLE} row(s)" in str(merged.issues[-1])
