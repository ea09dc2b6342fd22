"""Validation, profiles, provenance, citations and diffs on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Query, scratch, table
from rowproof.functions.text import render_text, row_fingerprint
from rowproof.operators import (
    Agg, SortKey, aggregate, dedupe, enrich, expand, explode_rows, extend, filter_rows, narrow, replace,
    sort_rank, union)
from rowproof.ordinals import ORD, number_kept
from rowproof.plans import StageDef, Workflow, preview, run_slice, slice_run
from rowproof.provenance import (
    Stage, cell_diff, check_citations, closure, contributor_rows, contributors, field_diff, filter_diff,
    multiset_cells, multiset_diff, publish_with, row_diff, trace_rows)
from rowproof.quality import (
    check_counts, check_keys, output_shape, profile, rollup_issues, stage_status, validate)
from rowproof.quality.profile import profile_source
from rowproof.quality.validate import issue_counts
from rowproof.schema import Col, Table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


# ── validation ──


@query("""
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind, value, CASE WHEN value > 90 THEN 'x' || event_id
             ELSE CAST(event_id AS VARCHAR) END AS code FROM events)
SELECT 'kind' AS "column", 'null' AS "check", count(*) FILTER (WHERE kind IS NULL) AS offenders FROM e
UNION ALL SELECT 'kind', 'enum', count(*) FILTER (WHERE kind IS NOT NULL AND kind NOT IN ('click', 'view')) FROM e
UNION ALL SELECT 'value', 'range', count(*) FILTER (WHERE value < 5 OR value > 80) FROM e
UNION ALL SELECT 'code', 'type', count(*) FILTER (WHERE TRY_CAST(code AS BIGINT) IS NULL) FROM e""")
def validate_counts(spark, folder):
    """Null, vocabulary, range and did-not-read-as-type checks in one pass."""
    events = replace(table(spark, folder, "events"), {
        "kind": "nullif(event_type, 'error')", "value": "value",
        "code": "CASE WHEN value > 90 THEN concat('x', event_id) ELSE cast(event_id as string) END"}).frame
    typed = events.select("kind", "value", F.expr("try_cast(code as bigint)").alias("code"),
                          F.col("code").alias("_raw_code"))
    return check_counts(typed, Table.of(
        Col("kind", "str", nullable=False, enum=("click", "view")), Col("value", "float", range=(5, 80)),
        Col("code", "int")))


@query("""
SELECT 'props' AS "column", 'value_type' AS "check",
       count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS offenders FROM events
UNION ALL SELECT 'sizes', 'type', count(*) FILTER (WHERE value <> floor(value)) FROM events""")
def validate_nested(spark, folder):
    """Open-map values and list elements."""
    events = table(spark, folder, "events").select(
        F.from_json("props", "map<string,string>").alias("props"), F.array("value", F.lit(None)).alias("sizes"))
    return check_counts(events, Table.of(
        Col("props", "json", value_type="int"), Col("sizes", "list[int]")))


@query("""
SELECT 'orders' AS "table", 'primary_key' AS kind, 'o_orderkey' AS key, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS offenders
UNION ALL SELECT 'lineitem', 'primary_key', 'l_orderkey,l_linenumber',
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))
UNION ALL SELECT 'lineitem', 'foreign_key', 'l_orderkey->orders.o_orderkey',
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'labels', 'primary_key', 'doc_id', (SELECT count(*) - count(DISTINCT doc_id) FROM labels)
UNION ALL SELECT 'labels', 'foreign_key', 'doc_id->conversations.conv_id',
  (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations))""")
def declared_keys(spark, folder):
    library = [
        Table((Col("o_orderkey", "int"),), name="orders", primary_key=("o_orderkey",)),
        Table((Col("l_orderkey", "int", references="orders.o_orderkey"), Col("l_linenumber", "int")),
              name="lineitem", primary_key=("l_orderkey", "l_linenumber")),
        Table((Col("doc_id", "int", references="conversations.conv_id"),), name="labels", primary_key=("doc_id",)),
        Table((Col("conv_id", "int"),), name="conversations")]
    tables = {t.name: table(spark, folder, t.name, ordinals=False) for t in library}
    return check_keys(tables, library)


def _issues(spark, folder):
    return table(spark, folder, "events", ordinals=False).select(
        F.concat(F.lit("stage"), F.col("user_id")).alias("stage"),
        F.when(F.col("value") > 50, "output").otherwise("input").alias("phase"),
        F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"),
        F.nullif("event_type", F.lit("view")).alias("column"),
        F.concat(F.lit("odd "), F.col("event_type")).alias("message"))


_ISSUES_SQL = """WITH i AS (SELECT 'stage' || user_id AS stage, CASE WHEN value > 50 THEN 'output' ELSE 'input' END AS phase,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, nullif(event_type, 'view') AS "column",
  'odd ' || event_type AS message FROM events)"""


@query(_ISSUES_SQL + """ SELECT stage, severity, "column", message, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases,
count(*) AS raised FROM i GROUP BY 1, 2, 3, 4""")
def issue_rollup(spark, folder):
    return rollup_issues(_issues(spark, folder)).withColumn("phases", F.array_join("phases", ","))


@query(_ISSUES_SQL + """ SELECT stage, count(*) FILTER (WHERE severity = 'error') AS errors,
count(*) FILTER (WHERE severity = 'warning') AS warnings FROM (SELECT DISTINCT stage, severity, "column", message FROM i) GROUP BY 1""")
def issue_totals(spark, folder):
    return issue_counts(_issues(spark, folder))


@query("""WITH e AS (SELECT 's' || user_id AS stage, nullif(event_type, 'signup') AS kind, value FROM events)
SELECT 'all' AS stage, count(*) AS rows, CASE WHEN count(*) FILTER (WHERE kind IS NULL OR value > 99.99) > 0 THEN 'error' ELSE 'ok' END AS status FROM e
UNION ALL SELECT 'typed', count(*), 'validation_warnings' FROM e""")
def stage_statuses(spark, folder):
    """A full report per stage, and the status it gives the stage."""
    events = replace(table(spark, folder, "events"), {"kind": "nullif(event_type, 'signup')", "value": "value"}).frame
    strict = Table.of(Col("kind", "str", nullable=False), Col("value", "float", range=(0, 99.99)))
    loose = Table.of(Col("kind", "str"))
    reports = [validate(events.drop("_src_file", "_src_row"), s, label) for label, s in (("all", strict), ("typed", loose))]
    return spark.createDataFrame([(r.stage, r.rows, stage_status(r)) for r in reports],
                                 "stage string, rows bigint, status string")


@query("""SELECT 'orders' AS stage, (SELECT count(*) FROM orders) AS rows, 6 AS columns UNION ALL
SELECT 'lineitem', (SELECT count(*) FROM lineitem), 11 UNION ALL SELECT 'events', (SELECT count(*) FROM events), 6""")
def output_shapes(spark, folder):
    shapes = [(n, *output_shape(table(spark, folder, n))) for n in ("orders", "lineitem", "events")]
    return spark.createDataFrame(shapes, "stage string, rows bigint, columns int")


# ── profiles ──


def _profile_sql(source: str, columns: dict[str, str], most: int) -> str:
    parts = []
    for column, number in columns.items():
        made = [f"min({number})", f"max({number})", f"round(avg({number}), 6)", f"round(median({number}), 6)"] if number else (
            ["CAST(NULL AS DOUBLE)"] * 4)
        figures = ", ".join(f'{f} AS "{n}"' for f, n in zip(made, ("min", "max", "mean", "median")))
        parts.append(f"""SELECT '{column}' AS "column", count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS distinct_count,
          (SELECT string_agg(v || ':' || n, ' ' ORDER BY n DESC, v) FROM (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM {source}
            WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {most})) AS "values",
          count(DISTINCT {column}) > {most} AS truncated, {figures} FROM {source}""")
    return " UNION ALL ".join(parts)


def _flat(profiled):
    shown = F.transform("values", lambda v: F.concat(v["value"], F.lit(":"), v["count"].cast("string")))
    return profiled.withColumns({"values": F.array_join(shown, " "), "mean": F.round("mean", 6),
                                 "median": F.round("median", 6)})


@query("WITH o AS (SELECT *, CAST(o_custkey AS VARCHAR) AS cust, nullif(o_orderstatus, 'P') AS status FROM orders) "
       + _profile_sql("o", {"o_orderkey": "o_orderkey", "cust": "CAST(cust AS DOUBLE)", "status": "",
                            "o_totalprice": "o_totalprice", "o_orderpriority": ""}, 5))
def profile_columns(spark, folder):
    orders = replace(table(spark, folder, "orders"), {
        "o_orderkey": "o_orderkey", "cust": "cast(o_custkey as string)", "status": "nullif(o_orderstatus, 'P')",
        "o_totalprice": "o_totalprice", "o_orderpriority": "o_orderpriority"}).frame
    return _flat(profile(orders, max_values=5))


@query("WITH " + "p AS (SELECT * FROM part) " + _profile_sql("p", {
    "p_brand": "", "p_type": "", "p_size": "p_size", "p_retailprice": "p_retailprice"}, 3))
def profile_file(spark, folder):
    return _flat(profile_source(spark, f"{folder}/part.parquet", "parquet",
                                ["p_brand", "p_type", "p_size", "p_retailprice"], 3))


@query("""SELECT c_custkey AS custkey, CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_mktsegment, '') AS c_mktsegment,
CAST(c_acctbal AS VARCHAR) AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS owes FROM customer""")
def cells_as_text(spark, folder):
    customers = table(spark, folder, "customer")
    shown = render_text(replace(customers, {"c_custkey": "c_custkey", "c_mktsegment": "c_mktsegment",
                                            "c_acctbal": "c_acctbal", "owes": "c_acctbal < 0"}).frame)
    return shown.select(F.col(ORD).alias("custkey"), "c_custkey", "c_mktsegment", "c_acctbal", "owes")


@query("""SELECT doc_id, substr(sha1('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"source":' ||
CASE WHEN lang = 'en' THEN 'null' ELSE '"' || source || '"' END || '}'), 1, 16) AS row_fp FROM documents""")
def row_fingerprints(spark, folder):
    documents = extend(table(spark, folder, "documents"), rewrites={
        "source": "CASE WHEN lang = 'en' THEN NULL ELSE source END"}).frame
    return documents.select("doc_id", row_fingerprint(documents, ["source", "doc_id", "n_chars"]).alias("row_fp"))


# ── lineage of each operator ──


def _edges(edges):
    return edges.select("stage", "ord", "pos", "parent_stage", "parent_ord", "kind",
                        F.coalesce(F.array_join("columns", ","), F.lit("")).alias("columns"))


def _edge_sql(stage, ord_, pos, parent, parent_ord, kind="direct", columns="''"):
    return (f"SELECT '{stage}' AS stage, CAST({ord_} AS BIGINT) AS ord, CAST({pos} AS INTEGER) AS pos, '{parent}' AS parent_stage, "
            f"CAST({parent_ord} AS BIGINT) AS parent_ord, '{kind}' AS kind, {columns} AS columns ")


@query(_edge_sql("kept", "row_number() OVER (ORDER BY o_orderkey) - 1", 0, "orders", "o_orderkey")
       + "FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'F'")
def lineage_filter(spark, folder):
    step = filter_rows(table(spark, folder, "orders"), "o_totalprice > 250000 AND o_orderstatus != 'F'")
    return _edges(step.edges("kept", "orders"))


@query(_edge_sql("both", "c_custkey", 0, "customer", "c_custkey") + "FROM customer UNION ALL "
       + _edge_sql("both", "s_suppkey + (SELECT count(*) FROM customer)", 1, "supplier", "s_suppkey") + "FROM supplier")
def lineage_union(spark, folder):
    customers = replace(table(spark, folder, "customer"), {"name": "c_name"}).frame
    suppliers = replace(table(spark, folder, "supplier"), {"name": "s_name"}).frame
    return _edges(union(customers, suppliers).edges("both", "customer", "supplier"))


@query(_edge_sql("named", "o_orderkey", 0, "orders", "o_orderkey") + "FROM orders UNION ALL "
       + _edge_sql("named", "o_orderkey", 1, "customer", "c_custkey")
       + "FROM orders JOIN customer ON o_custkey = c_custkey")
def lineage_enrich(spark, folder):
    step = enrich(table(spark, folder, "orders"), table(spark, folder, "customer"), [("o_custkey", "c_custkey")],
                  {"c_name": "customer"})
    return _edges(step.edges("named", "orders", "customer"))


_EXPANDED = """WITH x AS (SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY c_custkey, o_orderkey NULLS FIRST) - 1 AS place
FROM customer LEFT JOIN orders ON c_custkey = o_custkey) """


@query(_EXPANDED + _edge_sql("fanned", "place", 0, "customer", "c_custkey") + "FROM x UNION ALL "
       + _edge_sql("fanned", "place", 1, "orders", "o_orderkey") + "FROM x WHERE o_orderkey IS NOT NULL")
def lineage_expand(spark, folder):
    step = expand(table(spark, folder, "customer"), table(spark, folder, "orders"), [("c_custkey", "o_custkey")],
                  {"o_totalprice": "price"})
    return _edges(step.edges("fanned", "customer", "orders"))


@query("WITH w AS (SELECT p_partkey, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part) "
       + _edge_sql("words", "row_number() OVER (ORDER BY p_partkey, i) - 1", 0, "part", "p_partkey") + "FROM w")
def lineage_explode(spark, folder):
    part = replace(table(spark, folder, "part"), {"p_partkey": "p_partkey", "word": "split(p_name, ' ')"}).frame
    return _edges(explode_rows(part, "word").edges("words", "part"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
w AS (SELECT o_custkey, o_orderkey AS won, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM r WHERE n = 1) """
       + _edge_sql("best", "place", 0, "orders", "won") + "FROM w UNION ALL "
       + _edge_sql("best", "place", 1, "orders", "o_orderkey", "contribution") + "FROM r JOIN w USING (o_custkey) WHERE n > 1")
def lineage_dedupe(spark, folder):
    return _edges(dedupe(table(spark, folder, "orders"), ["o_custkey"], "highest", "o_totalprice").edges("best", "orders"))


@query(_edge_sql("sorted", "row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1", 0, "orders", "o_orderkey")
       + "FROM orders")
def lineage_sort(spark, folder):
    step = sort_rank(table(spark, folder, "orders"), [SortKey("o_orderpriority"), SortKey("o_totalprice", descending=True)])
    return _edges(step.edges("sorted", "orders"))


@query("""WITH g AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS place FROM (SELECT DISTINCT event_type FROM events)) """
       + _edge_sql("totals", "place", 0, "events", "event_id", "contribution",
                   "CASE WHEN value > 50 THEN 'n,big' ELSE 'n' END") + "FROM events JOIN g USING (event_type)")
def lineage_aggregate(spark, folder):
    step = aggregate(table(spark, folder, "events"), ["event_type"], [
        Agg("n", "count"), Agg("big", "count", where="value > 50")])
    return _edges(step.edges("totals", "events"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_totalprice > 100000")
def dense_positions(spark, folder):
    kept = filter_rows(table(spark, folder, "orders"), "o_totalprice > 100000")
    return number_kept(kept.frame, "_from", "place").select("o_orderkey", "place")


# ── traces over a small workflow ──


def _workflow(spark, folder):
    return Workflow([
        StageDef("orders", "input_data", lambda: narrow(
            table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])),
        StageDef("customers", "input_data", lambda: narrow(table(spark, folder, "customer"), ["c_custkey", "c_mktsegment"])),
        StageDef("named", "enrich", lambda o, c: enrich(o, c, [("o_custkey", "c_custkey")], {"c_mktsegment": "segment"}),
                 ("orders", "customers")),
        StageDef("banded", "python_row_function", lambda d: extend(d, {"band": "o_totalprice > 300000"}), ("named",)),
        StageDef("large", "filter_rows", lambda d: filter_rows(d, "band"), ("banded",)),
        StageDef("totals", "aggregate", lambda d: aggregate(d, ["segment", "o_orderpriority"], [
            Agg("orders", "count"), Agg("price", "sum", "o_totalprice")]), ("large",)),
    ])


def _history(spark, folder):
    flow = _workflow(spark, folder)
    run = flow.build(["totals"], stored=["large"])
    return run, {s.id: Stage(s.kind, s.inputs, run.table(s.id),
                             run.edges(s.id) if s.inputs and s.id != "banded" else None) for s in flow.stages}


_FLOW = """WITH named AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, c_mktsegment AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
large AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM named WHERE o_totalprice > 300000),
totals AS (SELECT segment, o_orderpriority, count(*) AS orders, sum(o_totalprice) AS price,
  row_number() OVER (ORDER BY segment NULLS LAST, o_orderpriority NULLS LAST) - 1 AS place FROM large GROUP BY 1, 2) """


@query(_FLOW + """SELECT place AS seed_ord, s.step, s.stage, CASE WHEN s.step = 0 THEN place ELSE o_orderkey END AS ord, s.ends
FROM large, (VALUES (0, 'large', NULL), (1, 'banded', NULL), (2, 'named', NULL), (3, 'orders', 'origin')) s(step, stage, ends)""")
def trace_back(spark, folder):
    """Every row of the filtered stage walked back to the file row it came from."""
    _, history = _history(spark, folder)
    seeds = history["large"].table.select(F.lit("large").alias("stage"), F.col(ORD).alias("ord"))
    return trace_rows(history, seeds).select("seed_ord", "step", "stage", "ord", "ends")


@query(_FLOW + """SELECT stage, ord, paged FROM (
SELECT 'totals' AS stage, place AS ord, true AS paged FROM totals UNION ALL SELECT 'large', place, true FROM large
UNION ALL SELECT 'banded', o_orderkey, false FROM large UNION ALL SELECT 'named', o_orderkey, false FROM large
UNION ALL SELECT 'orders', o_orderkey, false FROM large
UNION ALL SELECT DISTINCT 'customers', o_custkey, true FROM large WHERE segment IS NOT NULL)""")
def closure_rows(spark, folder):
    """All rows that explain the published totals."""
    _, history = _history(spark, folder)
    seeds = history["totals"].table.select(F.lit("totals").alias("stage"), F.col(ORD).alias("ord"))
    return closure(history, seeds, cap=None)


@query(_FLOW + """SELECT t.place AS ord, 'large' AS parent_stage, 'orders,price' AS columns, count(*) AS total,
CASE WHEN count(*) <= 3 THEN string_agg(CAST(l.place AS VARCHAR), ',' ORDER BY l.place) ELSE '' END AS named,
array_to_string(list(l.place ORDER BY l.place)[1:500], ',') AS rows
FROM large l JOIN totals t ON l.segment IS NOT DISTINCT FROM t.segment AND l.o_orderpriority = t.o_orderpriority GROUP BY t.place""")
def contributor_groups(spark, folder):
    run, _ = _history(spark, folder)
    found = contributors(run.edges("totals"), "totals")
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("columns", "named", "rows")})


@query(_FLOW + """SELECT l.o_orderkey, l.o_totalprice FROM large l JOIN totals t
ON l.segment IS NOT DISTINCT FROM t.segment AND l.o_orderpriority = t.o_orderpriority WHERE t.place = 4""")
def contributor_cohort(spark, folder):
    run, history = _history(spark, folder)
    return contributor_rows(run.edges("totals"), "totals", 4, "large", history["large"].table).select(
        "o_orderkey", "o_totalprice")


@query(_FLOW + """SELECT place AS ord, c.label, CASE WHEN c.label = 'segment' OR c.label = 'row' THEN 'ok'
WHEN c.label = 'orders' AND place < 3 THEN 'mismatch' WHEN c.label = 'orders' THEN 'ok' WHEN c.label = 'beyond' THEN 'no_row' ELSE 'no_column' END AS status
FROM totals, (VALUES ('segment'), ('orders'), ('row'), ('nothing')) c(label)
UNION ALL SELECT place + 1000000, 'beyond', 'no_row' FROM totals""")
def citation_checks(spark, folder):
    """Claims made about every published row, some of them wrong."""
    _, history = _history(spark, folder)
    totals = history["totals"].table
    off = F.when(F.col(ORD) < 3, 1).otherwise(0)

    def claim(ordinal, column, value, label):
        return F.struct(ordinal.alias("ord"), column.cast("string").alias("column"),
                        value.cast("string").alias("value"), F.lit(label).alias("label"))

    claims = totals.select(F.lit("totals").alias("stage"), F.inline(F.array(
        claim(F.col(ORD), F.lit("segment"), F.col("segment"), "segment"),
        claim(F.col(ORD), F.lit("orders"), (F.col("orders") + off).cast("string"), "orders"),
        claim(F.col(ORD), F.lit(None), F.lit(None), "row"),
        claim(F.col(ORD), F.lit("nothing"), F.lit("1"), "nothing"),
        claim(F.col(ORD) + 1000000, F.lit("orders"), F.lit("1"), "beyond"))))
    return check_citations(claims, {"totals": totals}).select("ord", "label", "status")


@query(_FLOW + """SELECT segment, orders, place AS cited FROM
(SELECT *, row_number() OVER (ORDER BY orders DESC, place) AS n FROM totals) WHERE n <= 5""")
def published_with_citations(spark, folder):
    """The five largest totals published by authored code, each figure citing its cell."""
    _, history = _history(spark, folder)

    def write(totals, output_dir, citations):
        shown = totals.orderBy(F.desc("orders"), ORD).limit(5)
        citations.cite(shown.select(
            F.lit("totals").alias("stage"), F.col(ORD).alias("ord"), F.lit("orders").alias("column"),
            F.col("orders").cast("string").alias("value"), F.col("segment").alias("label")))
        shown.drop(ORD).write.json(output_dir)
        return shown

    made, said = publish_with(write, {"totals": history["totals"].table}, scratch(spark, "artifact"))
    cited = said.where("status = 'ok'").select(F.col("ord").alias(ORD))
    return made.join(cited, ORD).select("segment", "orders", F.col(ORD).alias("cited"))


@query(_FLOW.replace("FROM orders LEFT", "FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') LEFT")
       + "SELECT segment, o_orderpriority, orders, round(price, 2) AS price FROM totals")
def workflow_slice(spark, folder):
    """The workflow's target when another table stands in for one of its sources."""
    finished = filter_rows(narrow(table(spark, folder, "orders"), [
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]), "o_orderstatus == 'F'")
    made = run_slice(_workflow(spark, folder), {"orders": finished.output().drop("o_orderstatus")}, "totals")
    return made.select("segment", "o_orderpriority", "orders", F.round("price", 2).alias("price"))


@query(_FLOW.replace("FROM orders LEFT", "FROM (SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100) LEFT")
       + "SELECT segment, o_orderpriority, orders, round(price, 2) AS price FROM totals")
def workflow_trial(spark, folder):
    """A trial run on a window of one source, the feature being the window."""
    flow = _workflow(spark, folder)
    run = slice_run(flow, {"orders": flow["orders"].make()}, limit=1000, offset=100)
    return run.table("totals").select("segment", "o_orderpriority", "orders", F.round("price", 2).alias("price"))


@query("SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS twice FROM orders WHERE o_orderkey IN (5, 900, 31)")
def operator_preview(spark, folder):
    """One operator shown on three chosen rows."""
    orders = narrow(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])
    shown, _ = preview(lambda d: extend(d, {"twice": "o_totalprice * 2"}), orders, [5, 900, 31, 5, -1])
    return shown


# ── diffs ──


def _changed(spark, folder):
    orders = narrow(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"])
    changed = replace(orders, {
        "o_orderkey": "o_orderkey", "o_totalprice": "CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END",
        "discounted": "o_totalprice > 100000"}).frame
    return orders, changed


@query("""SELECT 'o_orderkey' AS "column", 'carried' AS state, CAST(0 AS BIGINT) AS changed_cells
UNION ALL SELECT 'o_totalprice', 'carried', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'o_orderstatus', 'dropped', 0 UNION ALL SELECT 'discounted', 'added', 0""")
def column_diff(spark, folder):
    return row_diff(*_changed(spark, folder))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS VARCHAR) AS was,
CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS VARCHAR) AS now, o_orderstatus, o_totalprice FROM orders)
SELECT k AS ord, 'o_orderkey' AS "column", 'carried' AS state, CAST(k AS VARCHAR) AS was, CAST(k AS VARCHAR) AS now FROM o
UNION ALL SELECT k, 'o_totalprice', CASE WHEN was = now THEN 'carried' ELSE 'changed' END, was, now FROM o
UNION ALL SELECT k, 'o_orderstatus', 'dropped', o_orderstatus, NULL FROM o
UNION ALL SELECT k, 'discounted', 'added', NULL, CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END FROM o""")
def cell_differences(spark, folder):
    return cell_diff(*_changed(spark, folder), first=None)


@query("""SELECT 'o_orderkey' AS "column", 'carried' AS state, '7' AS was, '7' AS now UNION ALL
SELECT 'o_totalprice', CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE 'carried' END, CAST(o_totalprice AS VARCHAR),
CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS VARCHAR) FROM orders WHERE o_orderkey = 7 UNION ALL
SELECT 'o_orderstatus', 'dropped', o_orderstatus, NULL FROM orders WHERE o_orderkey = 7 UNION ALL
SELECT 'discounted', 'added', NULL, CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END FROM orders WHERE o_orderkey = 7""")
def one_row_diff(spark, folder):
    return field_diff(*_changed(spark, folder), 7, 7)


def _filter_diff(spark, folder):
    orders = narrow(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])
    return filter_diff(orders, filter_rows(orders, "o_totalprice > 250000").edges("kept", "orders"))


@query("""SELECT o_orderkey, o_totalprice > 250000 AS kept, CASE WHEN o_totalprice > 250000 THEN
count(*) FILTER (WHERE o_totalprice > 250000) OVER (ORDER BY o_orderkey) - 1 END AS output_ord FROM orders""")
def filter_diff_rows(spark, folder):
    return _filter_diff(spark, folder).rows.select("o_orderkey", "kept", "output_ord")


@query("""SELECT count(*) AS input_total, count(*) FILTER (WHERE o_totalprice > 250000) AS kept_total,
count(*) FILTER (WHERE o_totalprice <= 250000) AS dropped_total,
count(*) FILTER (WHERE o_totalprice <= 250000 AND o_orderkey >= 100) AS dropped_beyond_window FROM orders""")
def filter_diff_totals(spark, folder):
    return _filter_diff(spark, folder).totals


@query("""WITH e AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2),
a AS (SELECT CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2)
SELECT coalesce(e.quality, a.quality) AS quality, coalesce(e.toxic, a.toxic) AS toxic,
greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0) AS missing, greatest(coalesce(a.n, 0) - coalesce(e.n, 0), 0) AS unexpected
FROM e FULL JOIN a ON e.quality = a.quality AND e.toxic = a.toxic WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)""")
def multiset_counts(spark, folder):
    """Four distinct rows with very many copies each."""
    labels = table(spark, folder, "labels", ordinals=False)
    turned = labels.withColumn("quality", F.expr("CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END"))
    return multiset_diff(labels, turned, ["quality", "toxic"])


@query("""WITH e AS (SELECT quality, toxic, row_number() OVER (ORDER BY quality, toxic) - 1 AS row FROM labels),
a AS (SELECT q AS quality, toxic, row_number() OVER (ORDER BY q, toxic) - 1 AS row FROM
      (SELECT CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS q, toxic FROM labels))
SELECT row, 'quality' AS "column", CAST(e.quality AS VARCHAR) AS expected, CAST(a.quality AS VARCHAR) AS actual
FROM e JOIN a USING (row) WHERE e.quality <> a.quality
UNION ALL SELECT row, 'toxic', CAST(e.toxic AS VARCHAR), CAST(a.toxic AS VARCHAR) FROM e JOIN a USING (row) WHERE e.toxic <> a.toxic""")
def multiset_cell_differences(spark, folder):
    labels = table(spark, folder, "labels", ordinals=False)
    turned = labels.withColumn("quality", F.expr("CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END"))
    return multiset_cells(labels, turned, ["quality", "toxic"])
