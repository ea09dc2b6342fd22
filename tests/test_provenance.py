import pytest
from pyspark.sql import functions as F

from rowproof.errors import CitationMismatch, ContractError, GrainError, StepRefused
from rowproof.operators import Agg, SortKey, aggregate, enrich, extend, filter_rows, sort_rank, union
from rowproof.plans import StageDef, Workflow, grain_blockers, preview, run_slice, slice_run
from rowproof.provenance import (
    Stage, cell_diff, check_citations, cited_rows, closure, contributor_rows, contributors, field_diff,
    filter_diff, is_filter_lineage, multiset_cells, multiset_diff, require_citations, row_diff, trace_row,
    trace_rows)
from rowproof.provenance.citations import CLAIMS
from rowproof.schema import Col, Signature, Table


@pytest.fixture
def run(numbered):
    """orders -> enrich (clients) -> filter -> aggregate, with a row-code step in between."""
    orders = numbered([("o1", 1, 10), ("o2", 2, 20), ("o3", 1, 30), ("o4", 9, 40)], "o string, c int, amt bigint")
    clients = numbered([(1, "Ann"), (2, "Bob")], "c int, who string")
    flow = Workflow([
        StageDef("orders", "input_data", lambda: orders), StageDef("clients", "input_data", lambda: clients),
        StageDef("named", "enrich", lambda o, c: enrich(o, c, ["c"], {"who": "who"}), ("orders", "clients")),
        StageDef("doubled", "python_row_function", lambda d: extend(d, {"twice": "amt * 2"}), ("named",)),
        StageDef("known", "filter_rows", lambda d: filter_rows(d, "who IS NOT NULL"), ("doubled",)),
        StageDef("totals", "aggregate", lambda d: aggregate(
            d, ["who"], [Agg("total", "sum", "amt"), Agg("big", "count", where="amt > 15")]), ("known",))])
    built = flow.build(["totals"])
    history = {}
    for s in flow.stages:
        recorded = built.edges(s.id) if s.inputs and s.id != "doubled" else None
        history[s.id] = Stage(s.kind, s.inputs, built.table(s.id), recorded)
    return flow, built, history


def test_trace_one_row(run):
    _, _, history = run
    got = trace_row(history, "known", 2)
    assert [(s.stage, s.ord) for s in got.steps] == [("known", 2), ("doubled", 2), ("named", 2), ("orders", 2)]
    assert got.ends == "origin" and got.steps[1].introduced == ["twice"] and got.steps[1].made_by == "computed"
    assert got.steps[2].beside == [("clients", 0)] and got.steps[2].introduced == ["who"]
    assert got.steps[0].cells["who"] == "Ann"
    top = trace_row(history, "totals", 0)
    assert top.ends == "summary" and top.steps[0].fed_by == 2 and len(top.steps) == 1
    with pytest.raises(IndexError):
        trace_row(history, "known", 99)
    with pytest.raises(ContractError):
        trace_row(history, "nowhere", 0)
    reshaped = dict(history, known=Stage("filter_rows", ("doubled",), history["known"].table))
    assert trace_row(reshaped, "known", 0).ends == "unrecorded"
    lost = dict(history, doubled=Stage("python_row_function", ("named",), history["doubled"].table.where("_ord <> 2")))
    short = trace_row(lost, "known", 2)
    assert short.ends == "gone" and [s.stage for s in short.steps] == ["known"]


def test_trace_many_rows_agrees_with_one(run, spark):
    _, _, history = run
    seeds = spark.createDataFrame([("known", 0), ("known", 1), ("known", 2), ("totals", 1)], "stage string, ord bigint")
    got = {}
    for r in trace_rows(history, seeds).orderBy("seed_stage", "seed_ord", "step").collect():
        got.setdefault((r.seed_stage, r.seed_ord), []).append((r.stage, r.ord, r.ends))
    for (stage, ordinal), steps in got.items():
        assert [(s, o) for s, o, _ in steps] == [(s.stage, s.ord) for s in trace_row(history, stage, ordinal).steps]
    assert got[("known", 1)][-1] == ("orders", 1, "origin") and got[("totals", 1)] == [("totals", 1, "summary")]


def test_closure(run, spark):
    _, _, history = run
    seeds = spark.createDataFrame([("totals", 0)], "stage string, ord bigint")
    got = {(r.stage, r.ord): r.paged for r in closure(history, seeds).collect()}
    assert got == {("totals", 0): True, ("known", 0): True, ("known", 2): True, ("doubled", 0): False,
                   ("doubled", 2): False, ("named", 0): False, ("named", 2): False, ("orders", 0): False,
                   ("orders", 2): False, ("clients", 0): True}
    with pytest.raises(StepRefused, match="over the limit"):
        closure(history, seeds, cap=3)


def test_contributors(run):
    _, _, history = run
    edges = history["totals"].edges
    got = {(r.ord, tuple(r["columns"])): (r.total, r.named, r.rows) for r in contributors(edges, "totals").collect()}
    assert got == {(0, ("total",)): (1, [0], [0]), (0, ("total", "big")): (1, [2], [2]),
                   (1, ("total", "big")): (1, [1], [1])}
    many = contributors(edges, "totals", 0, linked=1, named=0).collect()
    assert all(r.named == [] and len(r.rows) == 1 for r in many)
    rows = contributor_rows(edges, "totals", 0, "known", history["known"].table, ["total", "big"])
    assert [r.o for r in rows.collect()] == ["o3"]


def test_citations(run, spark):
    _, _, history = run
    tables = {"totals": history["totals"].table}
    claims = [("totals", 0, "total", "40", "Ann"), ("totals", 0, "total", "41", "Ann?"), ("totals", 1, "who", "Bob", "b"),
              ("totals", 9, "who", "x", "far"), ("totals", 0, "nope", "x", "col"), ("gone", 0, "a", "x", "st"),
              ("totals", 1, None, None, "row"), ("totals", 0, "total", "40.0", "as float")]
    df = spark.createDataFrame(claims, CLAIMS)
    got = {r.label: r.status for r in check_citations(df, tables).collect()}
    assert got == {"Ann": "ok", "Ann?": "mismatch", "b": "ok", "far": "no_row", "col": "no_column",
                   "st": "no_stage", "row": "ok", "as float": "ok"}
    with pytest.raises(CitationMismatch):
        require_citations(df, tables)
    ordered = spark.createDataFrame([(*c, i) for i, c in enumerate(
        [("t", 5, None, None, ""), ("t", 2, "a", "1", ""), ("t", 5, "a", "1", ""), ("t", 2, None, None, "")])],
        CLAIMS + ", claim int")
    assert [(r.stage, r.ord) for r in cited_rows(ordered).collect()] == [("t", 2), ("t", 5)]


def test_row_diff(numbered):
    a = numbered([("x", 1), ("y", 2)], "name string, val bigint")
    b = numbered([("x", 1, True), ("Y", None, False)], "name string, val bigint, extra boolean")
    got = {r.column: (r.state, r.changed_cells) for r in row_diff(a, b).collect()}
    assert got == {"name": ("carried", 1), "val": ("carried", 1), "extra": ("added", 0)}
    back = {r.column: r.state for r in row_diff(b, a).collect()}
    assert back["extra"] == "dropped"
    cells = {(r.ord, r.column): (r.state, r.was, r.now) for r in cell_diff(a, b).collect()}
    assert cells[(1, "name")] == ("changed", "y", "Y") and cells[(1, "val")] == ("changed", "2", "")
    assert cells[(0, "extra")] == ("added", None, "True")
    one = {r.column: r.state for r in field_diff(a, b, 0, 0).collect()}
    assert one == {"name": "carried", "val": "carried", "extra": "added"}
    from rowproof.provenance.diff import require_aligned
    with pytest.raises(GrainError):
        require_aligned(a, numbered([("x",)], "name string"))


def test_filter_diff(numbered):
    df = numbered([("x", 1), ("y", -1), ("z", 2), ("w", -2)], "a string, b bigint")
    step = filter_rows(df, "b > 0")
    edges = step.edges("f", "src")
    found = filter_diff(df, edges, window=2)
    assert [(r.a, r.kept, r.output_ord) for r in found.rows.orderBy("_ord").collect()] == [
        ("x", True, 0), ("y", False, None), ("z", True, 1), ("w", False, None)]
    assert tuple(found.totals.first()) == (4, 2, 2, 1)
    assert is_filter_lineage(edges, df, step.output())
    turned = edges.withColumn("ord", 1 - F.col("ord"))
    assert not is_filter_lineage(turned, df, step.output())


def test_multisets(numbered):
    a = numbered([("x", 1.0), ("x", 1.0), ("y", None)], "s string, v double")
    b = numbered([("x", 1.0), ("y", float("nan")), ("z", 2.0)], "s string, v double")
    got = {r.s: (r.missing, r.unexpected) for r in multiset_diff(a, b, ["s", "v"]).collect()}
    assert got == {"x": (1, 0), "z": (0, 1)}
    cells = sorted((r.row, r.column, r.expected, r.actual) for r in multiset_cells(a, b, ["s", "v"]).collect())
    assert cells == [(1, "s", '"x"', '"y"'), (1, "v", "1.0", "null"), (2, "s", '"y"', '"z"'), (2, "v", "null", "2.0")]
    with pytest.raises(GrainError):
        multiset_cells(a, b.limit(1), ["s"])


def test_workflow_checks_and_slices(run, numbered):
    flow, _, _ = run
    swapped = numbered([("q", 5, 100)], "o string, c int, amt bigint")
    clients = numbered([(5, "Eve")], "c int, who string")
    table = run_slice(flow, {"orders": swapped, "clients": clients}, "totals")
    assert [tuple(r)[:2] for r in table.collect()] == [("Eve", 100)]
    assert grain_blockers(flow, "orders", "doubled") == []
    assert grain_blockers(flow, "orders", "totals") == ["known", "totals"]
    assert grain_blockers(flow, "clients", "named") == ["named"]
    for overrides, target in (({}, "totals"), ({"totals": swapped}, "totals"), ({"known": swapped}, "named")):
        with pytest.raises(ContractError):
            run_slice(flow, overrides, target)
    sources = {"orders": flow["orders"].make(), "clients": flow["clients"].make()}
    trial = slice_run(flow, sources, limit=2)
    assert {tuple(r)[:2] for r in trial.table("totals").collect()} == {("Ann", 10), ("Bob", 20)}
    shown, chosen = preview(lambda d: sort_rank(d, [SortKey("amt")]), sources["orders"], [3, 1, 3, 77])
    assert chosen == [3, 1] and {r.o for r in shown.collect()} == {"o4", "o2"}
    with pytest.raises(ContractError):
        Workflow([StageDef("a", "union", union, ("b",)), StageDef("b", "union", union, ("a",))])


def test_contracts_are_resolved_before_any_job(run):
    source = Table.of(Col("a", "str"), Col("n", "int", nullable=False))
    adds = Signature(reads={"src": Table.of(Col("n", "int"))}, adds=(Col("m", "float"),))
    flow = Workflow([StageDef("src", "input_data", lambda: None),
                     StageDef("x", "python_row_function", lambda d: d, ("src",), adds)])
    assert flow.schemas({"src": source})["x"].names == ["a", "n", "m"]
    with pytest.raises(ContractError, match="differs on nullable"):
        Signature(reads={"src": Table.of(Col("a", "str", nullable=False))}).check({"src": source})
    with pytest.raises(ContractError, match="absent"):
        Signature(reads={"src": Table.of(Col("zz", "str"))}).check({"src": source})
    with pytest.raises(ContractError):
        Signature(adds=(Col("_x", "str"),)).check({"src": source})
    assert source.subtract(Table.of(Col("a", "str"))).names == ["n"]
    with pytest.raises(ContractError):
        source.subtract(Table.of(Col("a", "int")))
    assert source.differing(Table.of(Col("a", "int"), Col("z", "str"))) == {"a", "n", "z"}
    assert Table.of(Col("a", "str")).is_subset_of(source)
    for bad in (dict(type="money"), dict(type="int", enum=("a",)), dict(type="json"), dict(type="str", range=(0, 1)),
                dict(type="int", range=(0, "up")), dict(type="str", fields=())):
        with pytest.raises(ContractError):
            Col("c", **bad)
    assert Col("c", "list[list[int]]").spark_type.simpleString() == "array<array<bigint>>"


def test_tables_that_do_not_align_are_refused(numbered):
    three, one = numbered([("x",), ("y",), ("z",)], "a string"), numbered([("x",)], "a string")
    with pytest.raises(Exception, match=r"refused: 3 input row\(s\) and 1 output row\(s\) share 1 position"):
        row_diff(three, one).collect()
    with pytest.raises(GrainError):
        cell_diff(three, one)
    with pytest.raises(Exception, match="refused: position [12] is in one table only"):
        cell_diff(three, one, None).collect()
    assert [tuple(r) for r in row_diff(one.where("a = 'no'"), one.where("a = 'no'")).collect()] == [("a", "carried", 0)]
