"""Filters, projections, joins, aggregates and reshapes on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Query, table
from rowproof.functions.predicate import mask
from rowproof.functions.text import render_template
from rowproof.operators import (
    Agg, SortKey, aggregate, dedupe, enrich, expand, explode_rows, extend, filter_rows, key_coverage,
    map_frames, map_rows, narrow, replace, rule_branches, search_rows, sort_rank, top, trim, union, window)
from rowproof.operators.aggregate import list_rows
from rowproof.operators.filter import rows_listed
from rowproof.operators.project import branch_coverage, check_writes
from rowproof.operators.join import align
from rowproof.ordinals import ORD
from rowproof.schema import Col, Table
from rowproof.sources.readers import split_list, spread

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


# ── the slice from source to report ──


@query("""
WITH per_order AS (
  SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue,
         nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS returned
  FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (WHERE revenue IS NULL) AS without_lines,
       round(coalesce(sum(revenue), 0), 4) AS revenue, CAST(coalesce(sum(returned), 0) AS BIGINT) AS returned
FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey GROUP BY 1""")
def revenue_by_priority(spark, folder):
    lines = narrow(table(spark, folder, "lineitem"),
                   ["l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"])
    priced = extend(lines, {"amount": "l_extendedprice * (1 - l_discount)"}).frame
    per_order = aggregate(priced, ["l_orderkey"], [
        Agg("revenue", "sum", "amount"), Agg("returned", "count", where="l_returnflag == 'R'")]).rows
    orders = narrow(table(spark, folder, "orders"), ["o_orderkey", "o_orderpriority"])
    named = enrich(orders, per_order, [("o_orderkey", "l_orderkey")],
                   {"revenue": "revenue", "returned": "returned"}, verify="in_plan").frame
    totals = aggregate(named, ["o_orderpriority"], [
        Agg("orders", "count"), Agg("without_lines", "count", where="revenue IS NULL"),
        Agg("revenue", "sum", "revenue"), Agg("returned", "sum", "returned")])
    return extend(totals.rows, rewrites={
        "revenue": "round(revenue, 4)", "without_lines": "coalesce(without_lines, 0)"}).rows


# ── filters ──


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
                  nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders)
SELECT * FROM o
WHERE coalesce(o_orderstatus <> 'F', true)
  AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')
  AND NOT (o_totalprice >= 450000) AND 2000 <= o_totalprice AND o_totalprice < 440000""")
def filter_predicate(spark, folder):
    orders = narrow(table(spark, folder, "orders"),
                    ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    holed = extend(orders, rewrites={"o_orderstatus": "nullif(o_orderstatus, 'P')"}).frame
    return filter_rows(holed, "o_orderstatus != 'F' AND (o_totalprice > 100000 OR o_orderpriority == "
                              "'1-URGENT') AND NOT o_totalprice >= 450000 AND 2000 <= o_totalprice < 440000").rows


@query("""
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind, CASE WHEN value > 50 THEN value END AS v FROM events)
SELECT event_id, kind IS NULL AS a, NOT coalesce(v < 80, false) AS b, coalesce(kind <> 'view', true) AS c,
       coalesce(v < 80, false) AND kind IS NOT NULL AS d,
       NOT (coalesce(kind = 'click', false) OR coalesce(v > 60, false)) AS e FROM e""")
def filter_nulls(spark, folder):
    events = narrow(table(spark, folder, "events"), ["event_id", "event_type", "value"])
    holed = replace(events, {"event_id": "event_id", "kind": "nullif(event_type, 'error')",
                             "v": "CASE WHEN value > 50 THEN value END"}).frame
    tests = {"a": "kind IS NULL", "b": "NOT v < 80", "c": "kind != 'view'",
             "d": "v < 80 AND kind IS NOT NULL", "e": "NOT (kind == 'click' OR v > 60)"}
    return replace(holed, {"event_id": "event_id", **{n: mask(t, holed) for n, t in tests.items()}}).rows


@query("""
SELECT p_partkey, regexp_matches(p_name, 'red|blue') AS has, regexp_matches(p_name, '^(?:small|large)') AS starts_one,
       regexp_full_match(p_name, '[a-z]+ ring') AS whole, contains(p_name, 'ring') AS plain,
       starts_with(p_brand, 'Brand#1') AS lead, ends_with(p_brand, '5') AS tail FROM part""")
def filter_strings(spark, folder):
    part = narrow(table(spark, folder, "part"), ["p_partkey", "p_name", "p_brand"])
    tests = {"has": "p_name.str.contains('red|blue')", "starts_one": "p_name.str.match('small|large')",
             "whole": "p_name.str.fullmatch('[a-z]+ ring')", "plain": "p_name.str.contains('ring')",
             "lead": "p_brand.str.startswith('Brand#1')", "tail": "p_brand.str.endswith('5')"}
    return replace(part, {"p_partkey": "p_partkey", **{n: mask(t, part) for n, t in tests.items()}}).rows


@query("""
WITH p AS (SELECT p_partkey, p_name, p_type, CAST(p_size AS VARCHAR) AS size, p_brand,
                  upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title FROM part)
SELECT p_partkey, regexp_full_match(p_type, '[A-Za-z]+') AS alpha, regexp_full_match(p_brand, '[A-Za-z0-9]+') AS alnum,
       regexp_full_match(size, '[0-9]+') AS digit, regexp_full_match(p_name, '[ ]+') AS space,
       true AS "ascii", p_name = lower(p_name) AND regexp_matches(p_name, '[a-z]') AS lower_case,
       p_type = upper(p_type) AND regexp_matches(p_type, '[A-Z]') AS upper_case,
       regexp_full_match(title, '[^A-Za-z]*[A-Z][a-z]*(?:[^A-Za-z]+[A-Z][a-z]*)*[^A-Za-z]*') AS title_case FROM p""")
def string_classes(spark, folder):
    part = replace(table(spark, folder, "part"), {
        "p_partkey": "p_partkey", "p_name": "p_name", "p_type": "p_type", "size": "cast(p_size as string)",
        "p_brand": "p_brand", "title": "concat(upper(substring(p_name, 1, 1)), substring(p_name, 2))"}).frame
    tests = {"alpha": "p_type.str.isalpha()", "alnum": "p_brand.str.isalnum()", "digit": "size.str.isdigit()",
             "space": "p_name.str.isspace()", "ascii": "p_name.str.isascii()", "lower_case": "p_name.str.islower()",
             "upper_case": "p_type.str.isupper()", "title_case": "title.str.istitle()"}
    return replace(part, {"p_partkey": "p_partkey", **{n: mask(t, part) for n, t in tests.items()}}).rows


@query("""SELECT doc_id, n_chars FROM documents
WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}') AND NOT contains(text, 'license')""")
def filter_whole_texts(spark, folder):
    documents = table(spark, folder, "documents")
    kept = filter_rows(documents, "text.str.contains('[0-9]{3}-[0-9]{4}') AND NOT text.str.contains('license')")
    return kept.rows.select("doc_id", "n_chars")


@query("""
WITH m AS (SELECT *, count(*) OVER () AS matched FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING')
SELECT c_custkey AS row, c_name, c_acctbal, matched, (SELECT count(*) FROM customer) AS scanned
FROM m ORDER BY c_custkey LIMIT 20""")
def row_search(spark, folder):
    customers = table(spark, folder, "customer")
    found = search_rows(customers, "c_acctbal < 0 OR c_mktsegment == 'BUILDING'")
    return found.rows.select(F.col(ORD).alias("row"), "c_name", "c_acctbal",
                             F.lit(found.matched).cast("bigint").alias("matched"),
                             F.lit(found.scanned).cast("bigint").alias("scanned"))


@query("SELECT event_id, event_type, value FROM events WHERE value > 90 AND event_type <> 'view'")
def filter_code(spark, folder):
    events = narrow(table(spark, folder, "events"), ["event_id", "event_type", "value"])
    return filter_rows(events, lambda row: row["value"] > 90 and row["event_type"] != "view").rows


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 400 AND o_orderkey < 900")
def row_window(spark, folder):
    orders = narrow(table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return window(orders, 400, 500).rows


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_by_position(spark, folder):
    documents = narrow(table(spark, folder, "documents"), ["doc_id", "lang", "n_chars"])
    wanted = table(spark, folder, "labels", ordinals=False).where("toxic = 1").select(F.col("doc_id").alias(ORD))
    return rows_listed(documents, wanted).select("doc_id", "lang", "n_chars")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_rows(spark, folder):
    orders = table(spark, folder, "orders", ordinals=False).select("o_orderkey", "o_totalprice")
    return top(orders, 25, [F.desc("o_totalprice"), F.asc("o_orderkey")])


# ── projections ──


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, lower(l_returnflag) AS l_returnflag,
       round(l_extendedprice * (1 - l_discount), 4) AS revenue,
       CASE WHEN l_extendedprice >= 70000 THEN 'large' WHEN l_extendedprice >= 20000 THEN 'middle' ELSE 'small' END AS band
FROM lineitem""")
def project_extend(spark, folder):
    lines = table(spark, folder, "lineitem")
    wide = extend(lines, {
        "revenue": "round(l_extendedprice * (1 - l_discount), 4)",
        "band": F.when(F.col("l_extendedprice") >= 70000, "large")
        .when(F.col("l_extendedprice") >= 20000, "middle").otherwise("small"),
    }, {"l_returnflag": "lower(l_returnflag)"}).frame
    declared = Table.of(Col("l_orderkey", "int"), Col("l_partkey", "int"), Col("l_suppkey", "int"),
                        Col("l_linenumber", "int"), Col("l_quantity", "float"), Col("l_returnflag", "str"),
                        Col("revenue", "float"), Col("band", "str"))
    trimmed, _ = trim(wide, declared)
    return trimmed.drop(ORD, "_src_file", "_src_row")


@query("""SELECT s_suppkey AS id, upper(s_name) AS name, s_acctbal < 0 AS owes FROM supplier""")
def project_replace(spark, folder):
    return replace(table(spark, folder, "supplier"), {
        "id": "s_suppkey", "name": "upper(s_name)", "owes": "s_acctbal < 0"}).rows


@query("""
SELECT c_custkey, 'Customer ' || c_name || ' {' || c_mktsegment || '} holds ' || CAST(c_acctbal AS VARCHAR)
       || ' in nation ' || coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'None') AS message FROM customer""")
def render_messages(spark, folder):
    customers = extend(table(spark, folder, "customer"), rewrites={"c_nationkey": "nullif(c_nationkey, 3)"}).frame
    template = "Customer {c_name} {{{c_mktsegment}}} holds {c_acctbal} in nation {c_nationkey}"
    return extend(customers, {"message": render_template(customers, template)}).rows.select("c_custkey", "message")


@query("""
SELECT event_id, CASE WHEN strlen(note) = 0 THEN 0 ELSE CAST(replace(substr(note, 2), ',', '') AS DOUBLE) END AS usd
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE '$' || CAST(value AS VARCHAR) END AS note FROM events)""")
def row_code(spark, folder):
    noted = replace(table(spark, folder, "events"), {
        "event_id": "event_id",
        "note": "CASE WHEN event_type = 'error' THEN '' ELSE concat('$', cast(value AS string)) END"}).frame

    def read_money(row):
        text = row["note"].lstrip("$").replace(",", "")
        return {"usd": float(text) if text else 0.0}

    return map_rows(noted, read_money, Table.of(Col("usd", "float")), reads=["note"]).rows.select("event_id", "usd")


@query("""
SELECT event_id, CASE WHEN event_type = 'signup' THEN event_id % 7 END AS points,
  CASE WHEN event_type = 'signup' THEN 'good' WHEN event_type <> 'error' THEN event_type END AS grade,
  CASE event_type WHEN 'click' THEN 'points: 0.5 (float) is no int64' WHEN 'error' THEN 'points: not written; grade: not written'
    WHEN 'signup' THEN NULL ELSE 'points: ''many'' (str) is no int64' END AS problem
FROM events""")
def row_code_errors(spark, folder):
    """A wrong type, a fraction in an integer and a forgotten key are each one row's own."""
    def graded(row):
        if row["event_type"] == "error":
            return {}
        if row["event_type"] == "signup":
            return {"points": row["event_id"] % 7, "grade": "good"}
        return {"points": 0.5 if row["event_type"] == "click" else "many", "grade": row["event_type"]}

    events = table(spark, folder, "events")
    made = map_rows(events, graded, Table.of(Col("points", "int"), Col("grade", "str")), reads=["event_id", "event_type"])
    return made.frame.select("event_id", "points", "grade", F.col("_error").alias("problem"))


@query("""
WITH v AS (SELECT value <> floor(value) AS fraction FROM events)
SELECT 'whole: a fraction' AS problem, count(*) AS rows FROM v WHERE fraction HAVING count(*) > 0""")
def row_write_types(spark, folder):
    """Fractions in a column that is declared to hold integers."""
    events = replace(table(spark, folder, "events"), {"whole": "value"}).frame
    checked = check_writes(events, Table.of(Col("whole", "int")))
    return (checked.where("_error IS NOT NULL").groupBy(F.regexp_replace("_error", "[0-9.E-]+ is not int$", "a fraction").alias("problem"))
            .agg(F.count(F.lit(1)).alias("rows")))


@query("""
SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def frame_code(spark, folder):
    def counted(nations, regions, customers):
        held = customers.groupBy("c_nationkey").count()
        return (nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
                .join(held, F.col("n_nationkey") == F.col("c_nationkey"), "left")
                .select("n_name", "r_name", F.coalesce("count", F.lit(0)).alias("customers")))
    return map_frames(counted, *[table(spark, folder, t, ordinals=False) for t in ("nation", "region", "customer")])


@query("""
WITH v AS (SELECT CASE WHEN event_type = 'error' THEN 'kind: required, but absent' END AS a,
                  CASE WHEN event_type IN ('view') THEN 'kind: view is outside its vocabulary' END AS b,
                  CASE WHEN value > 95 THEN 'value: ' || CAST(value AS VARCHAR) || ' is outside [0, 95]' END AS c FROM events),
     j AS (SELECT concat_ws('; ', a, b, c) AS problem FROM v)
SELECT problem, count(*) AS rows FROM j WHERE problem <> '' GROUP BY 1""")
def row_write_errors(spark, folder):
    events = replace(table(spark, folder, "events"), {"kind": "nullif(event_type, 'error')", "value": "value"}).frame
    declared = Table.of(Col("kind", "str", nullable=False, enum=("click", "purchase", "signup")),
                        Col("value", "float", range=(0, 95)))
    checked = check_writes(events, declared)
    return (checked.where("_error IS NOT NULL").groupBy(F.col("_error").alias("problem"))
            .agg(F.count(F.lit(1)).alias("rows")))


_ARMS = [("urgent", "o_orderpriority == '1-URGENT'"), ("large", "o_totalprice >= 400000"),
         ("open", "o_orderstatus == 'O'"), ("never", "o_totalprice < 0")]
_ARMS_SQL = """[x FOR x IN [CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
  CASE WHEN o_totalprice >= 400000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END,
  CASE WHEN o_totalprice < 0 THEN 'never' END] IF x IS NOT NULL]"""


@query(f"SELECT o_orderkey, array_to_string({_ARMS_SQL}, '>') AS branches FROM orders")
def rule_branch_paths(spark, folder):
    taken = rule_branches(table(spark, folder, "orders"), _ARMS)
    return taken.rows.select("o_orderkey", F.array_join("branches", ">").alias("branches"))


@query(f"""
WITH t AS (SELECT unnest({_ARMS_SQL}) AS branch FROM orders)
SELECT a.branch, count(t.branch) AS rows FROM (VALUES ('urgent'), ('large'), ('open'), ('never')) a(branch)
LEFT JOIN t ON t.branch = a.branch GROUP BY 1""")
def rule_branch_coverage(spark, folder):
    taken = rule_branches(table(spark, folder, "orders"), _ARMS)
    return branch_coverage(taken.frame, _ARMS)


# ── joins ──


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, nullif(o_custkey, 7) AS o_custkey FROM orders),
     c AS (SELECT nullif(c_custkey, 7) AS c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey <> 4 OR c_custkey = 7)
SELECT o.*, c_name AS customer, c_mktsegment AS segment FROM o LEFT JOIN c ON o_custkey IS NOT DISTINCT FROM c_custkey""")
def enrich_orders(spark, folder):
    orders = replace(table(spark, folder, "orders"), {
        "o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice", "o_custkey": "nullif(o_custkey, 7)"}).frame
    customers = filter_rows(table(spark, folder, "customer"), F.expr("c_nationkey <> 4 OR c_custkey = 7")).frame
    customers = extend(customers, rewrites={"c_custkey": "nullif(c_custkey, 7)"}).frame
    return enrich(orders, customers, [("o_custkey", "c_custkey")],
                  {"c_name": "customer", "c_mktsegment": "segment"}).rows


@query("""
WITH o AS (SELECT o_orderkey, nullif(o_custkey, 7) AS k FROM orders),
     c AS (SELECT nullif(c_custkey, 7) AS k, c_name FROM customer)
SELECT o_orderkey, c_name AS customer FROM o LEFT JOIN c ON o.k = c.k""")
def enrich_plain_equality(spark, folder):
    orders = replace(table(spark, folder, "orders"), {"o_orderkey": "o_orderkey", "k": "nullif(o_custkey, 7)"}).frame
    customers = replace(table(spark, folder, "customer"), {"k": "nullif(c_custkey, 7)", "c_name": "c_name"}).frame
    return enrich(orders, customers, ["k"], {"c_name": "customer"}, null_keys_match=False).rows.select(
        "o_orderkey", "customer")


@query("""
WITH pairs AS (SELECT l_partkey, l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l.l_partkey, l.l_suppkey, n AS pair_lines, q AS pair_quantity
FROM lineitem l LEFT JOIN pairs p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey""")
def enrich_composite(spark, folder):
    lines = narrow(table(spark, folder, "lineitem"),
                   ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    pairs = aggregate(lines, ["l_partkey", "l_suppkey"], [Agg("n", "count"), Agg("q", "sum", "l_quantity")]).rows
    step = enrich(lines, pairs, ["l_partkey", "l_suppkey"], {"n": "pair_lines", "q": "pair_quantity"}, verify="in_plan")
    return step.rows.drop("l_quantity")


@query("""SELECT c_custkey, c_name, o_orderkey AS "order", o_totalprice AS price
FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def expand_orders(spark, folder):
    customers = narrow(table(spark, folder, "customer"), ["c_custkey", "c_name"])
    return expand(customers, table(spark, folder, "orders"), [("c_custkey", "o_custkey")],
                  {"o_orderkey": "order", "o_totalprice": "price"}).rows


@query("""SELECT e.event_type, e.event_id, c.conv_id FROM (SELECT event_type, max(event_id) AS event_id FROM events GROUP BY 1) e
LEFT JOIN (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'view' WHEN 'assistant' THEN 'click' ELSE 'error' END AS k
           FROM conversations) c ON e.event_type = c.k""")
def expand_hot_keys(spark, folder):
    """A reference where few keys hold all rows, matched in slices."""
    events = aggregate(table(spark, folder, "events"), ["event_type"], [Agg("event_id", "max", "event_id")]).output()
    spoken = extend(table(spark, folder, "conversations"), {
        "k": "CASE role WHEN 'user' THEN 'view' WHEN 'assistant' THEN 'click' ELSE 'error' END"}).frame
    return expand(events, spoken, [("event_type", "k")], {"conv_id": "conv_id"}, hot_rows=50).rows


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), r AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'),
     gaps AS (SELECT 'reference' AS side, k FROM r WHERE k NOT IN (SELECT k FROM s)
              UNION ALL SELECT 'subject', k FROM s WHERE k NOT IN (SELECT k FROM r)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY CAST(k AS VARCHAR)) AS n FROM gaps)
SELECT side, count(*) AS absent,
       CASE side WHEN 'reference' THEN (SELECT count(*) FROM r) ELSE (SELECT count(*) FROM s) END AS total,
       string_agg(CAST(k AS VARCHAR), ', ' ORDER BY n) FILTER (WHERE n <= 10) AS sample
FROM ranked GROUP BY side""")
def key_coverage_report(spark, folder):
    lines = table(spark, folder, "lineitem", ordinals=False).select("l_orderkey")
    orders = table(spark, folder, "orders", ordinals=False).where("o_orderstatus <> 'F'").select("o_orderkey")
    report = key_coverage(lines, orders, [("l_orderkey", "o_orderkey")])
    return report.withColumn("sample", F.array_join("sample", ", "))


@query("""SELECT o_orderkey, o_custkey, event_id, value FROM orders JOIN events ON o_orderkey = event_id
WHERE o_orderkey < (SELECT least((SELECT count(*) FROM orders), (SELECT count(*) FROM events)))""")
def align_by_position(spark, folder):
    events = narrow(table(spark, folder, "events"), ["event_id", "value"])
    orders = narrow(table(spark, folder, "orders"), ["o_orderkey", "o_custkey"])
    n = min(events.count(), orders.count())
    both = align(window(orders, 0, n).output(), window(events, 0, n).output())
    return both.drop(ORD)


# ── aggregates ──


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_extendedprice), 2) AS price,
       round(avg(l_discount), 8) AS discount, min(l_shipdate) AS first_shipped, max(l_quantity) AS most,
       count(DISTINCT l_suppkey) AS suppliers,
       nullif(count(*) FILTER (WHERE l_quantity > 45), 0) AS big,
       CASE WHEN count(*) FILTER (WHERE l_tax > 0.07 AND l_returnflag = 'R') > 0 THEN
            round(coalesce(sum(l_extendedprice) FILTER (WHERE l_tax > 0.07 AND l_returnflag = 'R'), 0), 2) END AS taxed
FROM lineitem GROUP BY 1, 2""")
def agg_where(spark, folder):
    totals = aggregate(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], [
        Agg("lines", "count"), Agg("price", "sum", "l_extendedprice"), Agg("discount", "mean", "l_discount"),
        Agg("first_shipped", "min", "l_shipdate"), Agg("most", "max", "l_quantity"),
        Agg("suppliers", "count_distinct", "l_suppkey"), Agg("big", "count", where="l_quantity > 45"),
        Agg("taxed", "sum", "l_extendedprice", "l_tax > 0.07 AND l_returnflag == 'R'")])
    return extend(totals.rows, rewrites={"price": "round(price, 2)", "discount": "round(discount, 8)",
                                         "taxed": "round(taxed, 2)"}).rows


@query("""
WITH l AS (SELECT *, nullif(l_returnflag, 'R') AS flag, CASE WHEN l_tax > 0.02 THEN l_quantity END AS q FROM lineitem)
SELECT flag, count(*) FILTER (WHERE l_discount > 0.05) AS n,
       CASE WHEN count(*) FILTER (WHERE l_discount > 0.05) > 0 THEN coalesce(sum(q) FILTER (WHERE l_discount > 0.05), 0) END AS total,
       CASE WHEN count(*) FILTER (WHERE l_discount > 0.05) > 0 THEN count(DISTINCT q) FILTER (WHERE l_discount > 0.05) END AS kinds
FROM l WHERE l_discount > 0.05 GROUP BY 1""")
def agg_null_groups(spark, folder):
    lines = replace(table(spark, folder, "lineitem"), {
        "flag": "nullif(l_returnflag, 'R')", "q": "CASE WHEN l_tax > 0.02 THEN l_quantity END",
        "l_discount": "l_discount"}).frame
    only = "l_discount > 0.05"
    return aggregate(lines, ["flag"], [Agg("n", "count", where=only), Agg("total", "sum", "q", only),
                                       Agg("kinds", "count_distinct", "q", only)]).rows


@query("""
WITH e AS (SELECT *, nullif(event_type, 'error') AS kind FROM events)
SELECT user_id, arg_min(kind, event_id) FILTER (WHERE kind IS NOT NULL) AS first_kind,
       list(kind ORDER BY event_id)[1] AS first_any,
       array_to_string(list(coalesce(kind, '-') ORDER BY event_id), ',') AS kinds,
       coalesce(string_agg(kind, '' ORDER BY event_id) FILTER (WHERE value > 50 AND kind IS NOT NULL),
                CASE WHEN count(*) FILTER (WHERE value > 50) > 0 THEN '' END) AS joined
FROM e GROUP BY user_id""")
def agg_first_list(spark, folder):
    events = extend(table(spark, folder, "events"), {"kind": "nullif(event_type, 'error')"}).frame
    firsts = aggregate(events, ["user_id"], [
        Agg("first_kind", "first", "kind"), Agg("first_any", "first_including_null", "kind"),
        Agg("kinds", "list", "kind"), Agg("joined", "sum", "kind", "value > 50")])
    dashed = F.transform("kinds", lambda k: F.coalesce(k, F.lit("-")))
    return extend(firsts.rows, rewrites={"kinds": F.array_join(dashed, ",")}).rows


@query("""
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position, value AS v
FROM (SELECT nullif(event_type, 'error') AS event_type, event_id, value FROM events WHERE value > 20)""")
def agg_list_as_rows(spark, folder):
    """A few groups hold all rows, so their lists are kept as rows."""
    events = replace(table(spark, folder, "events"), {"event_type": "nullif(event_type, 'error')", "value": "value"}).frame
    return list_rows(events, ["event_type"], Agg("v", "list", "value", "value > 20"))


_WHOLE = [Agg("n", "count"), Agg("price", "sum", "l_extendedprice"), Agg("tax", "mean", "l_tax"),
          Agg("low", "min", "l_quantity"), Agg("high", "max", "l_quantity"), Agg("parts", "count_distinct", "l_partkey"),
          Agg("first_order", "first", "l_orderkey", "l_quantity > 49")]


@query("""SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_tax), 8) AS tax, min(l_quantity) AS low,
max(l_quantity) AS high, count(DISTINCT l_partkey) AS parts FROM lineitem""")
def agg_whole(spark, folder):
    whole = aggregate(table(spark, folder, "lineitem"), [], _WHOLE[:-1])
    return extend(whole.rows, rewrites={"price": "round(price, 2)", "tax": "round(tax, 8)"}).rows


@query("""SELECT CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS tax, CAST(NULL AS DOUBLE) AS low,
CAST(NULL AS DOUBLE) AS high, CAST(NULL AS BIGINT) AS parts, CAST(NULL AS BIGINT) AS first_order
FROM (SELECT count(*) AS c FROM lineitem WHERE l_quantity < 0) WHERE c = 0""")
def agg_whole_empty(spark, folder):
    none = filter_rows(table(spark, folder, "lineitem"), "l_quantity < 0").frame
    return aggregate(none, [], _WHOLE).rows


# ── reshapes ──


_PRIORITY = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"]


@query("""
SELECT o_orderkey, o_orderpriority, status, row_number() OVER (ORDER BY
  list_position(['3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH', '4-NOT SPECIFIED'], o_orderpriority),
  status DESC NULLS FIRST, o_custkey NULLS LAST, o_orderkey) AS rank
FROM (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)""")
def sort_with_rank(spark, folder):
    orders = extend(table(spark, folder, "orders"), {"status": "nullif(o_orderstatus, 'P')"}).frame
    ranked = sort_rank(orders, [SortKey("o_orderpriority", order=_PRIORITY),
                                SortKey("status", descending=True, nulls="first"),
                                SortKey("o_custkey", nulls="last")], "rank")
    return ranked.rows.select("o_orderkey", "o_orderpriority", "status", "rank")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def dedupe_first(spark, folder):
    return dedupe(narrow(table(spark, folder, "orders"), ["o_custkey", "o_orderkey", "o_totalprice"]), ["o_custkey"]).rows


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def dedupe_highest(spark, folder):
    orders = narrow(table(spark, folder, "orders"), ["o_custkey", "o_orderkey", "o_totalprice"])
    return dedupe(orders, ["o_custkey"], "highest", "o_totalprice").rows


@query("""SELECT status, o_orderpriority, o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'P') AS status, row_number() OVER
(PARTITION BY nullif(o_orderstatus, 'P'), o_orderpriority ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1""")
def dedupe_lowest_hot(spark, folder):
    """A few keys, absent ones included, hold all rows."""
    orders = replace(table(spark, folder, "orders"), {
        "status": "nullif(o_orderstatus, 'P')", "o_orderpriority": "o_orderpriority",
        "o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}).frame
    return dedupe(orders, ["status", "o_orderpriority"], "lowest", "o_totalprice").rows.drop("o_totalprice")


@query("""SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier
UNION ALL SELECT n_name, n_nationkey FROM nation""")
def union_inputs(spark, folder):
    customers = replace(table(spark, folder, "customer"), {"name": "c_name", "balance": "c_acctbal"}).frame
    suppliers = replace(table(spark, folder, "supplier"), {"balance": "s_acctbal", "name": "s_name"}).frame
    nations = replace(table(spark, folder, "nation"), {"name": "n_name", "balance": "n_nationkey"}).frame
    return union(customers, suppliers, nations).rows


@query("""WITH u AS (SELECT c_name AS name, 0 AS part, c_custkey AS k FROM customer WHERE c_acctbal > 2000
UNION ALL SELECT s_name, 1, s_suppkey FROM supplier WHERE s_acctbal > 2000 UNION ALL SELECT n_name, 2, n_nationkey FROM nation)
SELECT name, row_number() OVER (ORDER BY part, k) - 1 AS place FROM u""")
def union_of_filtered(spark, folder):
    """Positions run on without gaps where the inputs have lost rows."""
    customers = filter_rows(replace(table(spark, folder, "customer"), {"name": "c_name", "b": "c_acctbal"}).frame, "b > 2000").frame
    suppliers = filter_rows(replace(table(spark, folder, "supplier"), {"name": "s_name", "b": "s_acctbal"}).frame, "b > 2000").frame
    nations = replace(table(spark, folder, "nation"), {"name": "n_name", "b": "cast(0 AS double)"}).frame
    return union(customers, suppliers, nations).numbered().select("name", F.col(ORD).alias("place"))


@query(r"""SELECT count(*) FILTER (WHERE regexp_matches(text, '(?P<a>[[:upper:]])[[:alpha:]]+\.$')) AS ends,
  count(*) FILTER (WHERE regexp_matches(text, '^[^[:ascii:]]|\b[[:digit:]]{4}\b')) AS marked,
  count(*) FILTER (WHERE regexp_full_match(text, '(?s)[[:alpha:]].*[^[:punct:][:space:]]')) AS open_ends,
  count(*) FILTER (WHERE regexp_matches(text, '(?im)^(?P<first>the|der)\s')) AS lines FROM documents""")
def filter_patterns(spark, folder):
    """POSIX classes, named groups and anchors mean the same over whole texts as in the SQL engine."""
    documents = table(spark, folder, "documents", ordinals=False)
    tests = {"ends": r"text.str.contains('(?P<a>[[:upper:]])[[:alpha:]]+\\.$')",
             "marked": r"text.str.contains('^[^[:ascii:]]|\\b[[:digit:]]{4}\\b')",
             "open_ends": r"text.str.fullmatch('(?s)[[:alpha:]].*[^[:punct:][:space:]]')",
             "lines": r"text.str.contains('(?im)^(?P<first>the|der)\\s')"}
    return documents.agg(*[F.count_if(mask(test, documents)).alias(k) for k, test in tests.items()])


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_names(spark, folder):
    part = replace(table(spark, folder, "part"), {"p_partkey": "p_partkey", "word": "split(p_name, ' ')"}).frame
    return explode_rows(part, "word").rows


@query("""
WITH w AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL ELSE [x FOR x IN string_split(p_name, ' ') IF x IN ('red', 'ring')] END AS ws FROM part)
SELECT p_partkey, unnest(ws) AS word FROM w WHERE len(ws) > 0
UNION ALL SELECT p_partkey, NULL FROM w WHERE ws IS NULL OR len(ws) = 0""")
def explode_keep_empty(spark, folder):
    part = replace(table(spark, folder, "part"), {
        "p_partkey": "p_partkey",
        "word": "CASE WHEN p_size > 45 THEN NULL ELSE filter(split(p_name, ' '), x -> x IN ('red', 'ring')) END"}).frame
    return explode_rows(part, "word", keep_empty=True).rows


@query("""
WITH w AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents)
SELECT lang, count(*) AS words, count(DISTINCT word) AS kinds, max(word) AS last FROM w WHERE word <> '' GROUP BY lang""")
def explode_whole_texts(spark, folder):
    documents = replace(spread(table(spark, folder, "documents")), {"lang": "lang", "word": "split(text, ' ')"}).frame
    words = explode_rows(documents, "word").frame
    only = "word != ''"
    return aggregate(words.where("word <> ''"), ["lang"], [
        Agg("words", "count", where=only), Agg("kinds", "count_distinct", "word"), Agg("last", "max", "word")]).rows


@query("""SELECT p_partkey, array_to_string([trim(x) FOR x IN string_split(p_name || ', ,' || p_brand, ',') IF trim(x) <> ''], '|') AS parts FROM part""")
def list_split(spark, folder):
    part = replace(table(spark, folder, "part"), {
        "p_partkey": "p_partkey", "cell": "concat('[', p_name, ', ,', p_brand, ']')"}).frame
    return replace(part, {"p_partkey": "p_partkey", "parts": F.array_join(split_list(F.col("cell")), "|")}).rows


@query("""SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1""")
def json_fields(spark, folder):
    events = replace(table(spark, folder, "events"), {
        "event_type": "event_type", "k": F.from_json("props", "k int")["k"]}).frame
    return aggregate(events, ["event_type"], [Agg("total", "sum", "k"), Agg("n", "count")]).rows
