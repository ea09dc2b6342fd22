import datetime as dt
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError, GrainError
from rowproof.operators import extend
from rowproof.operators.calls import Reply, StageWideFailure, call_rows, rejoin, usage_total
from rowproof.operators.replay import (
    CACHE, cached_table, incremental_map, merge_cache, table_fingerprint, tables_fingerprint)
from rowproof.operators.review import (
    Queue, decisions_schema, definition_fingerprint, departures, queue_stats, record_decisions, review)
from rowproof.quality import runs
from rowproof.quality.scoring import (
    Expect, check_counts, check_expectations, deconflicted, example_rows, failed_rows, injected_table,
    rollup, run_cases, score, score_with)
from rowproof.schema import Col, Table
from rowproof.streaming.feed import EVENTS, follow_events

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ── review ──

QUEUE = Queue({"label": "final"}, filter="score > 10", sort=(("score", "descending"),), notes="note")
ROWS = [("a", 5, "x"), ("b", 20, "y"), ("c", None, "z"), ("d", 40, "x"), ("e", 40, "q")]


@pytest.fixture
def items(numbered):
    return numbered(ROWS, "id string, score bigint, label string")


def test_first_review_queues_or_skips(items):
    got = review(items, QUEUE)
    assert [(r.id, r.score) for r in got.pending.collect()] == [("d", 40), ("e", 40), ("b", 20)]
    assert [tuple(r) for r in got.done.rows.orderBy("id").collect()] == [
        ("a", 5, "x", "x", "skipped", None, None, None), ("c", None, "z", "z", "skipped", None, None, None)]
    assert tuple(queue_stats(got).first()) == (3, 2, 3, 0)


def test_recorded_decisions_are_replayed(items, spark):
    fp = definition_fingerprint("human_review_queue", QUEUE)
    pending = review(items, QUEUE).pending
    answers = pending.where("id <> 'b'").select(
        "row_fp", F.when(F.col("id") == "d", "x").otherwise("new").alias("final"), F.lit("pat").alias("reviewer"),
        F.lit("2026-01-01").alias("reviewed_at"), F.lit("seen").alias("notes"))
    made = record_decisions(pending, answers, QUEUE, fp)
    assert sorted(r.verdict for r in made.collect()) == ["approve", "modify"]
    later = made.withColumns({"final": F.lit("newest"), "reviewed_at": F.lit("2026-02-01"), "verdict": F.lit("modify")})
    for decisions, final in ((made, "new"), (made.unionByName(later), "newest")):
        again = review(items, QUEUE, decisions)
        done = {r.id: (r.final, r.verdict, r.note) for r in again.done.rows.collect()}
        assert done["e"] == (final, "modify", "seen") and set(done) == {"a", "c", "d", "e"}
        assert [r.id for r in again.pending.collect()] == ["b"]
    assert {r["_ord"]: r.final_departs for r in departures(review(items, QUEUE, made)).collect()} == {3: False, 4: True}
    other = review(items, Queue({"label": "final"}, filter="score > 11", notes="note"), made)
    assert other.pending.count() == 3
    wide = review(items, Queue({"label": "final"}, notes="note"), made, fp)
    assert tuple(queue_stats(wide).first()) == (5, 0, 3, 2)
    empty = spark.createDataFrame([], decisions_schema(items, QUEUE))
    assert review(items, QUEUE, empty).pending.count() == 3


def test_review_refuses(items):
    fp = "f" * 16
    pending = review(items, QUEUE).pending
    good = pending.select("row_fp", F.lit("x").alias("final"), F.lit("p").alias("reviewer"), F.lit("t").alias("reviewed_at"))
    for answers, queue in ((good.drop("final"), QUEUE), (good.withColumn("extra", F.lit(1)), QUEUE),
                           (good.withColumn("verdict", F.lit("skipped")), QUEUE),
                           (good.withColumn("notes", F.lit("n")), Queue({"label": "final"}))):
        with pytest.raises(ContractError):
            record_decisions(pending, answers, queue, fp)
    for queue in (Queue({"nope": "final"}), Queue({"label": "id"}), Queue({}), Queue({"label": "f"}, context=["label"]),
                  Queue({"label": "f"}, reads=["id"]), Queue({"label": "f"}, sort=(("nope", "ascending"),))):
        with pytest.raises(ContractError):
            review(items, queue)
    with pytest.raises(ContractError):
        review(items, QUEUE, auto_approve=True)
    done = review(items, QUEUE, auto_approve=True, test_run=True)
    assert {r.verdict for r in done.done.rows.collect()} == {"approve"} and done.pending.count() == 0
    from rowproof.errors import PredicateError
    with pytest.raises(PredicateError):
        review(items, Queue({"label": "f"}, filter="score + 1 > 2"))


# ── replay ──


def test_only_misses_are_computed(items, spark):
    writes = T.StructType([T.StructField("up", T.StringType()), T.StructField("n", T.LongType())])
    seen = spark.sparkContext.accumulator(0)

    def work(missed):
        counted = F.udf(lambda s: (seen.add(1), s.upper())[1], "string")
        return missed.withColumns({"up": counted("id"), "n": F.length("label").cast("bigint"),
                                   "_error": F.when(F.col("id") == "c", "boom")})

    first = incremental_map(items, None, work, writes, "s", "fp", reads=["id", "label"])
    rows = {r.id: (r.up, r["_error"], r["_source"]) for r in first.step.frame.collect()}
    assert rows["a"] == ("A", None, "computed") and rows["c"][1] == "boom" and seen.value == 5
    assert tuple(first.counts.first()) == (0, 5)
    cache = spark.createDataFrame(first.entries.collect(), CACHE)
    assert cache.count() == 4
    again = incremental_map(items, cache, work, writes, "s", "fp", reads=["label", "id"])
    assert {r.id: r["_source"] for r in again.step.frame.collect()} == {
        "a": "cached", "b": "cached", "c": "computed", "d": "cached", "e": "cached"}
    assert seen.value == 6 and {r.id: r.up for r in again.step.frame.collect()}["b"] == "B"
    assert incremental_map(items, cache, work, writes, "s", "other").counts.first()["hits"] == 0
    assert incremental_map(items, cache, work, writes, "s", "fp", ["id", "label"], bust_cache=True).counts.first()["hits"] == 0


def test_table_fingerprints(numbered, spark, tmp_path):
    a = numbered([("x", 1), ("y", 2)], "s string, n bigint")
    same = numbered([("x", 1), ("y", 2)], "s string, n bigint").repartition(3)
    turned = numbered([("y", 2), ("x", 1)], "s string, n bigint")
    assert table_fingerprint(a) == table_fingerprint(same) != table_fingerprint(turned)
    assert table_fingerprint(a) != table_fingerprint(a.select("n", "s", "_ord"))
    assert tables_fingerprint(a, turned) != tables_fingerprint(turned, a)
    made = []
    def make():
        made.append(1)
        return a
    for hit in (False, True):
        table, found = cached_table(spark, str(tmp_path), "s", "fp", [a], make)
        assert found is hit and table.count() == 2
    cached_table(spark, str(tmp_path), "s", "fp", [a], make, bust_cache=True)
    assert len(made) == 2


def test_caches_merge(spark):
    def entries(*keys):
        return spark.createDataFrame([(1, s, f, r, "{}", "{}", 1) for s, f, r in keys], CACHE)
    source = entries(("s", "f1", "a"), ("s", "f1", "b"), ("s", "f2", "c"), ("t", "f1", "d"))
    merged = merge_cache(source, entries(("s", "f1", "a")), spark.createDataFrame([("s", "f1")], "stage string, stage_fp string"))
    assert sorted(r.row_fp for r in merged.entries.collect()) == ["b", "c", "d"]
    assert {tuple(r) for r in merged.report.collect()} == {("s", 3, 2, 1, 2), ("t", 1, 1, 0, 0)}
    with pytest.raises(ValueError):
        merge_cache(source.withColumn("key_version", F.lit(9)), source, source)


# ── calls ──

ADDS = Table.of(Col("answer", "str"), Col("size", "int"))


def _answer(prompts, correction):
    return Reply([{"row_number": i, "answer": p.upper(), "size": len(p)} for i, p in reversed(list(enumerate(prompts)))],
                 {"input_tokens": 3, "output_tokens": 1, "cost_usd": 0.5, "model": "m1"})


def test_calls_row_by_row_and_in_batches(items):
    for size, calls in ((1, 5), (2, 3), (10, 1)):
        step = call_rows(items, _answer, ADDS, "{id}-{label}", batch_size=size)
        assert {r.id: (r.answer, r["size"]) for r in step.rows.collect()} == {
            "a": ("A-X", 3), "b": ("B-Y", 3), "c": ("C-Z", 3), "d": ("D-X", 3), "e": ("E-Q", 3)}
        total = usage_total(step.frame).first()
        assert (total.calls, total.input_tokens, total.cost_usd, total.model) == (calls, 3 * calls, 0.5 * calls, "m1")


def test_calls_carry_other_columns_untouched(numbered):
    big = 2 ** 60 + 1
    df = numbered([("a", big, [1]), ("b", None, None)], "t string, n bigint, l array<int>")
    for size in (1, 2):
        got = {r.t: (r.n, r.l, r.answer) for r in call_rows(df, _answer, ADDS, "{t}", batch_size=size).rows.collect()}
        assert got == {"a": (big, [1], "A"), "b": (None, None, "B")}


def test_batches_cross_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(20).select(F.col("id").cast("string").alias("t"), F.col("id").alias("_ord"))
        step = call_rows(df, _answer, ADDS, "{t}", batch_size=7)
        assert step.rows.count() == 20 and usage_total(step.frame).first().calls == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_failures_tag_rows(items):
    def flaky(prompts, correction):
        if any(p.startswith("b") for p in prompts):
            raise ValueError("cannot")
        return _answer(prompts, correction)

    single = {r.id: r["_error"] for r in call_rows(items, flaky, ADDS, "{id}", max_retries=0).frame.collect()}
    assert single == {"a": None, "b": "cannot", "c": None, "d": None, "e": None}
    paired = {r.id: r["_error"] for r in call_rows(items, flaky, ADDS, "{id}", batch_size=2, max_retries=0).frame.collect()}
    assert paired == {"a": "cannot", "b": "cannot", "c": None, "d": None, "e": None}

    def confused(prompts, correction):
        reply = _answer(prompts, correction)
        return reply if correction or len(prompts) == 1 else Reply(
            [{**r, "row_number": 0} for r in reply.results], reply.usage)

    mended = call_rows(items, confused, ADDS, "{id}", batch_size=2, max_retries=1).frame
    assert mended.where("_error IS NOT NULL").count() == 0 and usage_total(mended).first().calls == 5
    broken = call_rows(items, confused, ADDS, "{id}", batch_size=2, max_retries=0).frame.where("_error IS NOT NULL")
    assert broken.count() == 4 and "answered again [0]" in broken.first()["_error"]

    def slow(prompts, correction):
        raise TimeoutError("too slow")

    assert call_rows(items, slow, ADDS, "{id}", max_retries=5).frame.first()["_error"] == "too slow"

    def dead(prompts, correction):
        raise StageWideFailure("no credit")

    with pytest.raises(Exception, match="no credit"):
        call_rows(items, dead, ADDS, "{id}").rows.collect()


def test_rejoin_and_contract(items):
    assert rejoin([{"row_number": 1}, {"row_number": 0}], 2)[0] == [{"row_number": 0}, {"row_number": 1}]
    for bad in ([{"row_number": 0}], [{"row_number": 0}, {"row_number": 0}], [{"row_number": 0}, {"row_number": 5}],
                [{"row_number": 0}, {}], [{"row_number": 0}, {"row_number": 1}, {"row_number": 1}]):
        assert rejoin(bad, 2)[0] is None
    for template, adds, reads in (("{nope}", ADDS, None), ("{id}", Table.of(), None), ("{id}", Table.of(Col("id", "str")), None),
                                  ("{id}", ADDS, ["label"])):
        with pytest.raises(ContractError):
            call_rows(items, _answer, adds, template, reads=reads)
    def two(prompts, correction):
        return Reply(_answer(prompts, correction).results, {"model": prompts[0]})
    with pytest.raises(Exception, match="two models"):
        usage_total(call_rows(items, two, ADDS, "{id}").frame).collect()


# ── scoring ──


def test_metrics(numbered):
    data = numbered([("x", 10.0, 5.0), ("y", 20.0, -5.0), (None, float("nan"), 0.0)], "label string, amt double, delta double")
    target = numbered([("x", 10.4, 99.0), ("WRONG", 21.0, 3.0), (None, 1.0, 0.0)], "label string, amt double, delta double")
    checks = [Expect("label"), Expect("amt", "abs_tol", 0.5), Expect("delta", "sign")]
    got = score(data, target, checks)
    assert [tuple(r[f"{c}__match"] for c in ("label", "amt", "delta")) + (r.row_passed,) for r in got.orderBy("_ord").collect()] == [
        (True, True, True, True), (False, False, False, False), (False, False, True, False)]
    total = rollup(got).first()
    assert (total["rows_scored"], total["rows_passed"], round(total["accuracy.delta"], 4)) == (3, 1, 0.6667)
    assert {r.column: (r.matched, r.failed) for r in check_counts(got).collect()} == {"label": (1, 2), "amt": (1, 2), "delta": (2, 1)}
    assert failed_rows(got).count() == 2 and failed_rows(got.drop("row_passed")).count() == 2
    assert tuple(rollup(score(data.where("false"), target.where("false"), checks)).first())[:3] == (0, 0, 0.0)
    with pytest.raises(GrainError):
        score(data, target.where("_ord < 2"), checks)
    with pytest.raises(ContractError):
        Expect("label", "abs_tol")
    with pytest.raises(ContractError):
        check_expectations(Table.of(Col("label", "str")), [Expect("label", "sign")])


def test_names_are_deconflicted(numbered):
    assert deconflicted(["k", "v"], ["v", "w"]) == ({"k": "k", "v": "override.v"}, {"v": "output.v", "w": "w"})
    data = numbered([("a", 1, 1)], "k string, `override.v` bigint, `output.v` bigint")
    assert injected_table(data, ["k", "v"], ["v"]).columns == ["k", "v", "_ord"]
    target = numbered([(2,)], "v bigint")
    assert score(data, target, [Expect("v")], override=["k", "v"]).first()["row_passed"] is False
    assert score_with(lambda t, d: t.join(d, "_ord"), target, data).count() == 1


def test_cases_run_at_once(spark):
    inputs = spark.createDataFrame([("one", 1), ("one", 2), ("two", 3), ("three", -5), ("four", -7), ("five", 7)], "case_id string, n bigint")
    expected = spark.createDataFrame([("one", 4), ("one", 2), ("two", 7), ("three", -10)], "case_id string, n bigint")

    def double(df):
        grown = df.withColumn("n", F.when(F.col("n") == -7, F.raise_error(F.lit("refused: negative")).cast("bigint")).otherwise(F.col("n") * 2))
        return grown
    contract = {"in": Table.of(Col("case_id", "str"), Col("n", "int", range=(-100, 100)))}
    got = {r.case_id: (r.status, r.detail) for r in run_cases(double, {"in": inputs}, expected, ["n"], contract, ["four", "five"]).collect()}
    assert got["one"] == ("passed", None) and got["three"][0] == "passed"
    assert got["two"] == ("mismatch", "1 row(s) differ") and got["four"][0] == "passed"
    assert got["five"] == ("mismatch", "expected the step to fail, got 1 row(s)")
    tight = {"in": Table.of(Col("case_id", "str"), Col("n", "int", range=(0, 100)))}
    bad = {r.case_id: r.status for r in run_cases(double, {"in": inputs.where("n <> -7")}, expected, ["n"], tight).collect()}
    assert bad == {"one": "passed", "two": "mismatch", "three": "malformed", "five": "mismatch"}


def test_example_rows(spark, numbered):
    done = spark.createDataFrame([("r1", "s", "ok"), ("r2", "s", "ok"), ("r3", "s", "error")], "run_id string, stage_id string, status string")
    old, new = numbered([("old", 1)], "a string, b int"), numbered([("new", 1)], "a string, b int")
    rows, profiled = example_rows({"r1": old, "r2": new}, done, "s", ["a"])
    assert [r.a for r in rows.collect()] == ["new"] and profiled.count() == 1
    with pytest.raises(ContractError):
        example_rows({}, done, "nothing", ["a"])


# ── run roll-ups ──


def test_durations(spark):
    rows = [("a", "2026-01-01T00:00:00+00:00", "2026-01-01T01:02:03+00:00", "ok"),
            ("b", "2026-01-01T00:00:00", "2026-01-01T00:00:09.500", "ok"),
            ("c", "2026-01-01T00:00:00Z", "2026-01-01T00:00:09", "ok"), ("d", "2026-01-01T00:01:00", "2026-01-01T00:00:00", "ok"),
            ("e", "nonsense", "2026-01-01T00:00:00", "ok"), ("f", "2026-01-01T00:00:00Z", None, "running"),
            ("g", "2026-01-01T00:00:00Z", None, "ok"), ("h", "2026-01-01T00:00:00+02:00", "2026-01-01T00:00:00Z", "ok")]
    df = spark.createDataFrame(rows, "run_id string, started_at string, finished_at string, status string")
    got = {r.run_id: r.elapsed for r in runs.durations(df, now="2026-01-01T00:02:05Z").collect()}
    assert got == {"a": "1h 02m", "b": "9s", "c": None, "d": None, "e": None, "f": "2m 05s", "g": None, "h": "2h 00m"}


def test_spend(spark):
    rows = [(dt.datetime(2026, 1, 1, 9), "run", "m1", "p", 1.0, 10, 1, 1), (dt.datetime(2026, 1, 4, 9), "chat", None, "", 3.0, 5, 1, 1)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, source string, model string, project string, cost_usd double, "
                                     "input_tokens bigint, output_tokens bigint, calls bigint")
    assert [(str(r.day), r.cost_usd, r.entries) for r in runs.daily(df).collect()] == [
        ("2026-01-01", 1.0, 1), ("2026-01-02", 0.0, 0), ("2026-01-03", 0.0, 0), ("2026-01-04", 3.0, 1)]
    assert [r.label for r in runs.spend_by(df, "model").collect()] == ["not recorded", "m1"]
    assert [r.label for r in runs.spend_by(df, "project").collect()] == ["no project", "p"]
    assert runs.daily(df.where("false")).count() == 0 and runs.spend_total(df.where("false")).first()["entries"] == 0


def test_event_feed_follows_the_log(spark, tmp_path):
    log = str(tmp_path / "log")
    events = [(i, None, "run_done" if i == 4 else "row_ok", 0, "s" if i % 2 else "t", i, "computed", "") for i in range(5)]
    spark.createDataFrame(events[:3], EVENTS).write.parquet(log)
    feed = follow_events(spark, log, since=1, stage="s").writeStream.format("memory").queryName("feed").start()
    try:
        feed.processAllAvailable()
        assert [r.seq for r in spark.table("feed").orderBy("seq").collect()] == [1]
        spark.createDataFrame(events[3:], EVENTS).write.mode("append").parquet(log)
        feed.processAllAvailable()
        assert [r.seq for r in spark.table("feed").orderBy("seq").collect()] == [1, 3, 4]
    finally:
        feed.stop()


def test_row_operators_take_a_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, None, "row_ok", 0, "s", 1, "", "x")], EVENTS).write.parquet(log)
    made = extend(follow_events(spark, log), {"upper": "upper(text)"}).frame
    assert made.isStreaming


def test_a_decision_without_a_time_counts_until_a_dated_one(spark):
    from rowproof.operators.review import latest_decisions
    rows = [("fp", "a", "approve", None), ("fp", "b", "approve", None), ("fp", "b", "reject", "2024-01-01")]
    decisions = spark.createDataFrame(rows, "stage_fp string, row_fp string, verdict string, reviewed_at string")
    found = {r.row_fp: r._d.verdict for r in latest_decisions(decisions, "fp").collect()}
    assert found == {"a": "approve", "b": "reject"}


def test_text_equals_no_number_in_an_exact_score(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from rowproof.quality.scoring import Expect, _matches
    df = spark.createDataFrame([("x", 1)], "e string, a int")
    check = Expect("a", metric="exact")
    assert df.select(_matches(check, F.col("e"), F.col("a"), T.StringType(), T.IntegerType()).alias("m")).first().m is False


def test_the_answer_recorded_last_replays(items, spark):
    writes = T.StructType([T.StructField("up", T.StringType())])
    def answer(text):
        return lambda missed: missed.withColumn("up", F.concat(F.lit(text), F.col("id")))
    first = incremental_map(items, None, answer("z-old-"), writes, "s", "fp", reads=["id"])
    cache = spark.createDataFrame(first.entries.collect(), CACHE)
    bust = incremental_map(items, cache, answer("a-new-"), writes, "s", "fp", reads=["id"], bust_cache=True)
    newer = spark.createDataFrame([*cache.collect(), *bust.entries.collect()], CACHE)
    assert newer.groupBy("row_fp").agg(F.countDistinct("seq").alias("n")).where("n <> 2").count() == 0
    again = incremental_map(items, newer, answer("no"), writes, "s", "fp", reads=["id"])
    assert {r.up for r in again.step.frame.collect()} == {f"a-new-{i}" for i in "abcde"}
    # Entries of a cache without a sequence are older than any with one.
    plain = incremental_map(items, cache.drop("seq"), answer("no"), writes, "s", "fp", reads=["id"])
    assert {r.up for r in plain.step.frame.collect()} == {f"z-old-{i}" for i in "abcde"}


def test_batches_are_of_rows_not_of_positions(spark):
    rows = [(f"t{i}", i * 1000003) for i in range(17)]
    df = spark.createDataFrame(rows, "t string, _ord bigint").repartition(5)
    step = call_rows(df, _answer, ADDS, "{t}", batch_size=8)
    assert usage_total(step.frame).first()["calls"] == 3
    assert {r.t: r.answer for r in step.rows.collect()} == {r.t: r.answer for r in call_rows(df, _answer, ADDS, "{t}").rows.collect()}


def test_a_reply_off_its_declaration_fails_its_row(items):
    def odd(prompts, correction):
        return Reply([{"row_number": i, "answer": 3 if p == "b" else p, **({} if p == "c" else {"size": i})} for i, p in enumerate(prompts)])
    got = {r.id: (r.answer, r["_error"]) for r in call_rows(items, odd, ADDS, "{id}", batch_size=5).frame.collect()}
    assert got["a"] == ("a", None) and got["b"][0] is None and "3 (int)" in got["b"][1]
    assert got["c"] == ("c", "size: not written") and got["e"] == ("e", None)


def test_answers_must_meet_one_pending_row_each(items):
    pending = review(items, QUEUE).pending
    good = pending.select("row_fp", F.lit("x").alias("final"), F.lit("p").alias("reviewer"), F.lit("t").alias("reviewed_at"))
    assert record_decisions(pending, good.unionByName(good), QUEUE, "f").count() == 3
    first = good.limit(1)
    with pytest.raises(ContractError, match=r"0 answer\(s\) to rows that are not pending and 1 row\(s\) answered in two ways"):
        record_decisions(pending, good.unionByName(first.withColumn("final", F.lit("y"))), QUEUE, "f")
    with pytest.raises(ContractError, match=r"1 answer\(s\).*gone \(unknown\)"):
        record_decisions(pending, good.unionByName(first.withColumn("row_fp", F.lit("gone"))), QUEUE, "f")


def test_merged_cache_agrees_with_its_sql_across_langs_and_nulls(spark, tmp_path):
    """A text of one source in two langs of which one is labelled, and null sources, langs and texts."""
    import catalogue
    import oracle
    docs = [(1, "same", "de", "web"), (2, "same", "en", "web"), (3, "same", "fr", "book"), (4, "alone", None, "web"),
            (5, None, "de", "web"), (6, "none", "de", None), (7, "none", "de", None), (8, "other", "en", "book")]
    spark.createDataFrame([(*d, 4) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(
        1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(
        str(tmp_path / "labels.parquet"))
    con = oracle.duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert oracle.difference(catalogue.QUERIES["cache_merged"](spark, str(tmp_path)), con, catalogue.SQL["cache_merged"]) is None


def test_replay_copies_no_cells_of_the_rows(spark, numbered, tmp_path):
    """What is landed on the way to a replayed answer is narrow, however wide the rows are."""
    import glob

    from rowproof.session import session_folder
    rows = numbered([(f"{i}" * 4000, i) for i in range(20)], "wide string, id int")
    writes = T.StructType([T.StructField("n", T.IntegerType())])
    before = set(glob.glob(f"{session_folder(spark).removeprefix('file:')}/*"))
    work = lambda d: d.withColumn("n", F.length("wide"))
    first = incremental_map(rows, None, work, writes, "s", "fp", reads=["wide"])
    cache = spark.createDataFrame(first.entries.toArrow())
    again = incremental_map(rows, cache.where("row_fp < '8'"), work, writes, "s", "fp", reads=["wide"])
    assert [(r.id, r.n) for r in again.step.frame.orderBy("id").collect()] == [(i, len(str(i)) * 4000) for i in range(20)]
    assert {r.frozen_input for r in cache.collect()} == {'{"wide":"' + f"{i}" * 4000 + '"}' for i in range(20)}
    made = set(glob.glob(f"{session_folder(spark).removeprefix('file:')}/*")) - before
    assert len(made) >= 3
    assert not [p for p in made if "wide" in spark.read.parquet(p).columns or "frozen_input" in spark.read.parquet(p).columns]
