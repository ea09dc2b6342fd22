import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from rowproof.errors import ContractError
from rowproof.quality import validate
from rowproof.schema import Col, Table
from rowproof.sources import export_bundle, export_csv, lost_cells, publish, read_source, source_edges, weigh_files, write_output
from rowproof.sources.readers import spread


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(text)
    return path


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("_ord").select(*columns).collect()]


def test_declared_text_survives(spark, tmp_path):
    path = put(tmp_path, "a.csv", "id,n\n002,5\n017,6\n")
    schema = Table.of(Col("id", "str"), Col("n", "int"))
    df = read_source(spark, path, schema=schema)
    assert rows(df, "id", "n", "_ord") == [("002", 5, 0), ("017", 6, 1)]
    assert rows(read_source(spark, path), "n") == [("5",), ("6",)]


def test_tabs_encodings_and_quotes(spark, tmp_path):
    tabs = put(tmp_path, "t.csv", "a\tb\n1\tx,y\n")
    assert rows(read_source(spark, tabs), "a", "b") == [("1", "x,y")]
    assert rows(read_source(spark, put(tmp_path, "u.tsv", "a\tb\n1\t2\n")), "b") == [("2",)]
    latin = put(tmp_path, "l.csv", "naïve,n\ncafé – “x” €,1\n", "windows-1252")
    assert rows(read_source(spark, latin), "naïve") == [("café – “x” €",)]
    with open(latin, "ab") as out:
        out.write(b"\x81\xe9,2\n")
    with pytest.raises(ContractError, match="neither UTF-8 nor"):
        read_source(spark, latin)
    quoted = put(tmp_path, "q.csv", 'a,b\n"line one\nline ""two""",1\nplain,2\n')
    assert rows(read_source(spark, quoted), "a", "b") == [('line one\nline "two"', "1"), ("plain", "2")]
    one = put(tmp_path, "o.csv", "only\nx\n")
    assert rows(read_source(spark, one), "only") == [("x",)]
    both = put(tmp_path, "b.csv", "a,b\tc\n1,2\t3\n4,5\t6\n")
    with pytest.raises(ContractError, match="do not tell which"):
        read_source(spark, both)


def test_cells_read_as_declared(spark, tmp_path):
    path = put(tmp_path, "c.csv", "i,f,b,d,t,s\n5,1.5,True,2026-01-02,2026-01-02 03:04:05,NA\n"
                                  "6.0,NaN,FALSE,1/31/2026,20260131,\nx,y,maybe,never,Jan 5, 2026,n/a\n".replace("Jan 5, 2026", '"Jan 5, 2026"'))
    schema = Table.of(Col("i", "int"), Col("f", "float"), Col("b", "bool"), Col("d", "date"), Col("t", "datetime"), Col("s", "str"))
    df = read_source(spark, path, schema=schema)
    day, at = dt.date, dt.datetime
    assert rows(df, "i", "f", "b", "d", "t", "s") == [
        (5, 1.5, True, day(2026, 1, 2), at(2026, 1, 2, 3, 4, 5), None),
        (6, None, False, day(2026, 1, 31), at(2026, 1, 31), None),
        (None, None, None, None, at(2026, 1, 5), None)]
    problems = {i.column: i.message for i in validate(df, schema).issues}
    assert set(problems) == {"i", "f", "b", "d"} and "1 value(s) do not read as 'int', among them 'x'" in problems["i"]
    wins = read_source(spark, path, schema=schema, dtype={"i": "str"}, parse_dates=["t"])
    assert rows(wins, "i") == [("5",), ("6.0",), ("x",)]


def test_lists(spark, tmp_path):
    path = put(tmp_path, "l.csv", 'id,tags\n1,"[a, b ,,c]"\n2,\n3,solo\n')
    df = read_source(spark, path, list_columns=["tags"])
    assert rows(df, "tags") == [(["a", "b", "c"],), ([],), (["solo"],)]


def test_json_lines(spark, tmp_path):
    lines = [{"id": "002", "n": 3, "tags": ["x"], "o": {"a": 1}}, {"id": "7", "n": None, "tags": [], "o": None}]
    path = put(tmp_path, "j.jsonl", "\n".join(json.dumps(x) for x in lines))
    schema = Table.of(Col("id", "str"), Col("n", "int"), Col("tags", "list[str]"), Col("o", "json", fields=(Col("a", "int"),)))
    df = read_source(spark, path, schema=schema)
    assert rows(df, "id", "n", "tags") == [("002", 3, ["x"]), ("7", None, [])]
    assert df.select("o.a").first()[0] == 1


def test_geojson(spark, tmp_path):
    def feature(props, geometry):
        return {"type": "Feature", "properties": props, "geometry": geometry}
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 1], [0, 0]]]}
    path = put(tmp_path, "g.geojson", json.dumps({"type": "FeatureCollection", "features": [
        feature({"name": "a", "cap": 1}, {"type": "Point", "coordinates": [1.5, 2.5]}),
        feature({"name": "b", "cap": 2}, shape), feature({"name": "c", "cap": None}, None)]}))
    df = read_source(spark, path)
    assert rows(df, "name", "cap", "lon", "lat") == [("a", 1, 1.5, 2.5), ("b", 2, None, None), ("c", None, None, None)]
    kept = put(tmp_path, "k.geojson", json.dumps({"type": "FeatureCollection", "features": [
        feature({"lon": 9.5, "lat": 8.5}, {"type": "Point", "coordinates": [1, 2]})]}))
    assert rows(read_source(spark, kept), "lon", "lat") == [(9.5, 8.5)]


def test_files_read_in_order(spark, tmp_path):
    b = put(tmp_path, "b.csv", "x,y\n" + "".join(f"b{i},{i}\n" for i in range(5)))
    a = put(tmp_path, "a.csv", "y,x\n0,a0\n1,a1\n")
    df = read_source(spark, [b, a])
    assert rows(df, "x", "_ord", "_src_row") == [(f"b{i}", i, i) for i in range(5)] + [("a0", 5, 0), ("a1", 6, 1)]
    with pytest.raises(ContractError, match=r"c.csv.*lacks \['y'\]"):
        read_source(spark, [b, put(tmp_path, "c.csv", "x,z\n1,2\n")])
    with pytest.raises(ContractError, match="share a format"):
        read_source(spark, [b, "d.json"])
    with pytest.raises(ContractError, match="does not exist"):
        read_source(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ContractError):
        read_source(spark, str(tmp_path / "book.xlsx"))
    edges = source_edges(df, "in", weigh_files(spark, [b, a])).orderBy("ord").collect()
    assert [(e.ord, e.parent_ord, os.path.basename(e.source_file)) for e in edges][4:6] == [(4, 4, "b.csv"), (5, 0, "a.csv")]
    assert edges[0].source_sha == hashlib.sha256(open(b, "rb").read()).hexdigest()


def test_positions_over_many_splits(spark, tmp_path):
    """One text file read in many splits, and parquet in many files: every position is right."""
    path = put(tmp_path, "big.csv", "n,s\n" + "".join(f"{i},{'v' * (i % 50)}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000b")
    try:
        df = read_source(spark, path, schema=Table.of(Col("n", "int"), Col("s", "str")))
        assert df.where(F.col("n") != F.col("_ord")).count() == 0 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = str(tmp_path / "parts")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(parts)
    read = read_source(spark, parts, "parquet")
    assert read.where(F.col("id") != F.col("_ord")).count() == 0
    assert read_source(spark, parts, "parquet", ordinals=False).columns == ["id"]
    assert spread(read_source(spark, path, ordinals=False)).rdd.getNumPartitions() >= 4


def test_weighing(spark, tmp_path):
    path = put(tmp_path, "w.csv", "a\n1\n")
    row = weigh_files(spark, [path]).first()
    assert (row.path, row.filename, row.bytes) == (path, "w.csv", 4)
    assert row.sha256 == hashlib.sha256(b"a\n1\n").hexdigest()
    with pytest.raises(ContractError, match="no1.*no2"):
        weigh_files(spark, [str(tmp_path / "no1"), path, str(tmp_path / "no2")])


def test_sinks(spark, tmp_path, numbered):
    df = numbered([("a", [1, 2], 1), ('q"x', None, 2)], "s string, l array<int>, n bigint")
    assert write_output(df, str(tmp_path / "o")).format == "parquet"
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    odd = write_output(df.withColumn("v", F.lit(None)), str(tmp_path / "odd"))
    assert odd.format == "csv" and "'v'" in odd.note
    export_csv(df.coalesce(1), str(tmp_path / "e"))
    part = next(f for f in os.listdir(tmp_path / "e") if f.startswith("part"))
    raw = open(tmp_path / "e" / part, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfs,l,n\n") and b'"q""x"' in raw and b"[1,2]" in raw
    publish(df, str(tmp_path / "p"), "json", one_file_per="n")
    assert sorted(os.listdir(tmp_path / "p"))[-2:] == ["n=1", "n=2"]
    for bad in ({"format": "xlsx"}, {"one_file_per": "zz"}):
        with pytest.raises(ContractError):
            publish(df, str(tmp_path / "bad"), **bad)


def test_bundle(spark, tmp_path, numbered):
    source = put(tmp_path, "in.csv", "a\n1\n")
    df = numbered([("a", 1)], "s string, n bigint")
    bundle = export_bundle(spark, {"one": df, "gone": None}, str(tmp_path / "b"), [source],
                           spark.createDataFrame([("r1", "ok")], "run_id string, status string"))
    held = {r.path: r.sha256 for r in bundle.checksums.collect()}
    assert [r.stage for r in bundle.omitted.collect()] == ["gone"]
    copied = [p for p in held if p.endswith("0-in.csv")]
    assert len(copied) == 1 and held[copied[0]] == hashlib.sha256(b"a\n1\n").hexdigest()
    for part in ("/outputs/one/", "/tables/one/", "/records/", "/omitted/"):
        assert any(part in p for p in held)
    for path, digest in held.items():
        assert hashlib.sha256(open(path, "rb").read()).hexdigest() == digest


def test_lines_with_too_many_cells_are_refused(spark, tmp_path):
    good = put(tmp_path, "good.csv", "a,b\n1,2\n")
    wide = put(tmp_path, "wide.csv", 'a,b\n1,x\n\n2,"y,z"\n3,y,EXTRA\n4,5,6,7\n')
    with pytest.raises(ContractError, match=r"wide.csv: line 5 has 3 cells, its header 2"):
        read_source(spark, [good, wide])
    tabs = put(tmp_path, "wide.tsv", "a\tb\n1\t2\t3\n")
    with pytest.raises(ContractError, match="line 2 has 3 cells"):
        read_source(spark, tabs)
    spanning = put(tmp_path, "span.csv", 'a,b\n"one\ntwo",1\n"x, y\nz",2,3\n')
    with pytest.raises(ContractError, match="span.csv: the record that begins .* has more than 2 cells"):
        read_source(spark, spanning)
    short = put(tmp_path, "short.csv", "a,b\n1\n2,x\n")
    assert rows(read_source(spark, short), "a", "b") == [("1", None), ("2", "x")]
    later = put(tmp_path, "later.csv", "a,b\tc\n" + "1,2\t3\n" * 30 + "4,5 6\n")
    assert read_source(spark, later).columns[:2] == ["a", "b\tc"]
    assert rows(read_source(spark, put(tmp_path, "empty.csv", "a,b\n")), "a") == []


def test_broken_json_lines_are_refused(spark, tmp_path):
    good = put(tmp_path, "good.jsonl", '{"a": 1}\n\n{"a": null}\n')
    assert rows(read_source(spark, good), "a") == [("1",), (None,)]
    for text in ('{"a": 1}\n{"a": 2\n{"a": 3}\n', '{"a": 1}\n[1]\n', '{"a": 1}\n7\n'):
        with pytest.raises(ContractError, match="bad.jsonl: line 2 is not a JSON object"):
            read_source(spark, [good, put(tmp_path, "bad.jsonl", text)])


def test_types_that_do_not_go_together(spark, tmp_path, numbered):
    for folder, ddl, value in (("i", "x int, y string", 1), ("d", "x double, y string", 2.5), ("s", "x string, y string", "t")):
        spark.createDataFrame([(value, "k")], ddl).write.parquet(str(tmp_path / folder))
    wide = read_source(spark, [str(tmp_path / "i"), str(tmp_path / "d")], "parquet")
    assert rows(wide, "x") == [(1.0,), (2.5,)] and wide.schema["x"].dataType.simpleString() == "double"
    with pytest.raises(ContractError, match="'x' is int in one input and string"):
        read_source(spark, [str(tmp_path / "i"), str(tmp_path / "s")], "parquet")


def test_date_spellings_and_lost_dates(spark, tmp_path):
    good = {"2024/01/05": (2024, 1, 5), "5 Jan 2024": (2024, 1, 5), "05-Jan-2024": (2024, 1, 5), "January 5 2024": (2024, 1, 5),
            "2024.1.5": (2024, 1, 5), "31/01/2024": (2024, 1, 31), "1-31-2024": (2024, 1, 31), "5 march 2024": (2024, 3, 5),
            "2024/01/05 3:04": (2024, 1, 5, 3, 4), "Jan 5, 2024 3:04:05 PM": (2024, 1, 5, 15, 4, 5), "1/5/2024 12:00 am": (2024, 1, 5),
            "2024-01-05T03:04:05": (2024, 1, 5, 3, 4, 5), "20240105": (2024, 1, 5)}
    bad = ["never", "2024/13/05", "32 Jan 2024", "1/5/2024 25:00", "1/5/2024 13:00 pm", "5 Foo 2024"]
    path = put(tmp_path, "d.csv", "k,d\n" + "".join(f'{i},"{t}"\n' for i, t in enumerate([*good, *bad, ""])))
    df = read_source(spark, path, parse_dates=["d"])
    assert rows(df, "d") == [(dt.datetime(*v),) for v in good.values()] + [(None,)] * (len(bad) + 1)
    assert [tuple(r) for r in lost_cells(df).collect()] == [("d", len(bad))]


def test_undeclared_columns_can_be_inferred(spark, tmp_path):
    path = put(tmp_path, "i.csv", "i,f,b,s,z,c\n1,1,true,1,,007\nNA,2.5,False,x,,8\n-3,1e3,TRUE,2,,9\n")
    df = read_source(spark, path, infer=True, dtype={"c": "str"})
    assert rows(df, "i", "f", "b", "s", "z", "c") == [(1, 1.0, True, "1", None, "007"), (None, 2.5, False, "x", None, "8"), (-3, 1000.0, True, "2", None, "9")]
    declared = read_source(spark, path, infer=True, schema=Table.of(Col("i", "str")))
    assert declared.schema["i"].dataType.simpleString() == "string" and declared.schema["f"].dataType.simpleString() == "double"


def test_point_coordinates_fill_absent_keys_only(spark, tmp_path):
    def point(props):
        return {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}
    path = put(tmp_path, "p.geojson", json.dumps({"type": "FeatureCollection", "features": [
        point({"n": "whole", "lon": 7, "lat": "north"}), point({"n": "absent"}), point({"n": "null", "lon": None}), point(None)]}))
    assert rows(read_source(spark, path), "n", "lon", "lat") == [
        ("whole", 7.0, "north"), ("absent", 1.5, "2.5"), ("null", None, "2.5"), (None, 1.5, "2.5")]
    bare = put(tmp_path, "bare.geojson", json.dumps({"type": "FeatureCollection", "features": [point({}), point(None)]}))
    assert rows(read_source(spark, bare), "lon", "lat") == [(1.5, 2.5)] * 2
