import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rowproof.errors import ContractError
from rowproof.functions.text import (
    canonical_json, escaped_columns, plain_number, render_template, render_text,
    row_fingerprint, template_fields)

NUMBERS = [0.0, 1.0, -2.5, 1234567.0, 12345678.0, 1.23456789e9, 9.99e15, 1e16, 1.5e-5, 0.0001, 0.001,
           1e22, 123456789012.34, 0.1 + 0.2, -1e7]


def test_numbers_read_as_python_writes_them(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double").coalesce(1)
    got = [r[0] for r in df.select(plain_number(F.col("x"))).collect()]
    assert got == [repr(x) for x in NUMBERS]


def test_fingerprints_equal_frozen_values(spark):
    # Two rows and the fingerprints they must keep.
    rows = [("a", 1.0, 0.5, ["x", "y"], dt.datetime(2026, 1, 1), True),
            ("b", None, 2.0, [], dt.datetime(2026, 2, 1), False)]
    df = spark.createDataFrame(rows, "id string, n double, score double, tags array<string>, "
                                     "when timestamp_ntz, flag boolean")
    got = [r[0] for r in df.select(row_fingerprint(df)).collect()]
    assert got == ["f7b3dbcee3434b6f", "8cf1a35ba171fc08"]


def test_canonical_json_escapes_like_ascii_json(spark):
    texts = ["plain", 'quo"te\\', "tab\tnew\nline", "é中", "😀x", ""]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "z string, a bigint").coalesce(1)
    got = [r[0] for r in df.select(canonical_json(df)).collect()]
    want = [json.dumps({"z": t, "a": i}, sort_keys=True, separators=(",", ":")) for i, t in enumerate(texts)]
    assert got == want
    hashes = [r[0] for r in df.select(row_fingerprint(df)).collect()]
    assert hashes == [hashlib.sha1(w.encode()).hexdigest()[:16] for w in want]


def test_column_order_and_null_forms_do_not_move_a_fingerprint(spark):
    a = spark.createDataFrame([(1, float("nan"))], "x bigint, y double")
    b = spark.createDataFrame([(None, 1)], "y double, x bigint")
    assert a.select(row_fingerprint(a)).first() == b.select(row_fingerprint(b)).first()


def test_render_text(spark):
    df = spark.createDataFrame([(None, True, 2.0, dt.datetime(2026, 1, 1, 5, 0, 0, 500000), [1, None])],
                               "a string, b boolean, c double, d timestamp_ntz, e array<int>")
    assert tuple(render_text(df).first()) == ("", "True", "2.0", "2026-01-01 05:00:00.500000", "[1,null]")


def test_template(spark):
    df = spark.createDataFrame([("Ann", 3, 2.5), (None, 4, None)], "who string, n bigint, x double").coalesce(1)
    made = [r[0] for r in df.select(render_template(df, "Hi {who}: {n} {{who}} {x:.2f}")).collect()]
    assert made[0] == "Hi Ann: 3 {who} 2.50"
    assert made[1].startswith("Hi None: 4 {who} ")
    assert template_fields("{a} {b.c} {{d}}") == {"a", "b"}
    assert escaped_columns("{{who}} {n}", df.columns) == ["who"]
    with pytest.raises(ContractError):
        render_template(df, "{nobody}")
