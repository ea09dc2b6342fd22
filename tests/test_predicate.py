import math
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from rowproof.errors import PredicateError
from rowproof.functions.predicate import check_regex, columns_read, condition, mask

ROWS = [("a", 1, 1.5, True, "Hit One"), (None, None, None, None, None),
        ("Ab", 3, float("nan"), False, ""), ("b2", -1, 4.0, True, "ÉTÉ x"), ("  ", 5, 0.0, None, "Title Case")]
DDL = "s string, n bigint, f double, flag boolean, `Opening Text` string"


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, " + DDL).coalesce(1)


def kept(df, text):
    by_filter = [r.i for r in df.where(condition(text, df)).orderBy("i").collect()]
    by_mask = [r.i for r in df.where(mask(text, df)).orderBy("i").collect()]
    assert by_filter == by_mask
    flags = [r[0] for r in df.orderBy("i").select(mask(text, df)).collect()]
    assert None not in flags
    return by_filter


@pytest.mark.parametrize("text, expected", [
    ("s == 'a'", [0]),
    ("s != 'a'", [1, 2, 3, 4]),
    ("NOT s == 'a'", [1, 2, 3, 4]),
    ("NOT s != 'a'", [0]),
    ("n > 1", [2, 4]),
    ("NOT n > 1", [0, 1, 3]),
    ("0 < n < 5", [0, 2]),
    ("NOT 0 < n < 5", [1, 3, 4]),
    ("f IS NULL", [1, 2]),
    ("f IS NOT NULL", [0, 3, 4]),
    ("f.isna()", [1, 2]),
    ("NOT f IS NULL", [0, 3, 4]),
    ("f > 1", [0, 3]),
    ("f != 4.0", [0, 1, 2, 4]),
    ("flag", [0, 3]),
    ("NOT flag", [1, 2, 4]),
    ("flag == true", [0, 3]),
    ("n > 1 AND f IS NULL", [2]),
    ("n > 1 & f.isna() | s == 'a'", [0, 2]),
    ("n > 1 OR s == 'x AND y'", [2, 4]),
    ("(n == 1 OR n == 3) AND NOT flag", [2]),
    ("NOT (n > 1 AND f > 3)", [0, 1, 2, 3, 4]),
    ("`Opening Text`.str.contains('One')", [0]),
    ("`Opening Text`.str.contains('O.e|Case')", [0, 4]),
    ("NOT `Opening Text`.str.contains('One')", [1, 2, 3, 4]),
    ("`Opening Text`.str.match('Hit|Tit')", [0, 4]),
    ("`Opening Text`.str.fullmatch('Hit .*')", [0]),
    ("`Opening Text`.str.startswith('Ti')", [4]),
    ("`Opening Text`.str.endswith('x')", [3]),
    ("s.str.isalpha()", [0, 2]), ("s.str.isalnum()", [0, 2, 3]), ("s.str.isspace()", [4]),
    ("s.str.islower()", [0, 3]), ("s.str.isupper()", []), ("s.str.istitle()", [2]),
    ("`Opening Text`.str.isascii()", [0, 2, 4]), ("`Opening Text`.str.istitle()", [0, 4]),
    ("n < f", [0, 3]), ("f > n", [0, 3]), ("f <= f", [0, 3, 4]), ("n != f", [0, 1, 2, 3, 4]),
    ("NOT n < f", [1, 2, 4]), ("s == 3", []), ("s != 3", [0, 1, 2, 3, 4]), ("n == 's'", []),
])
def test_rows_kept(df, text, expected):
    assert kept(df, text) == expected


@pytest.mark.parametrize("text", [
    "n + 1 > 2", "n in (1, 2)", "n is None", "n > -1", "len(s) > 1", "s.str.contains('a', case=False)",
    "s.str.upper()", "missing > 1", "`No Such` == 1", "Opening Text == 'a'", "n", "5", "s.str.contains(s)",
    "f.str.contains('a')", "__import__('os')", "s.str.contains('(?=a)')", r"s.str.contains('(a)\\1')",
])
def test_refused(df, text):
    with pytest.raises(PredicateError):
        df.where(condition(text, df))


def test_reads_and_regex():
    assert columns_read("a > 1 AND `b c` IS NULL", ["a", "b c"]) == {"a", "b c"}
    check_regex("a+b")
    with pytest.raises(PredicateError):
        check_regex(r"(?<=a)b")


def test_simple_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(condition("id > 90 AND s.str.startswith('9')", df))._jdf.queryExecution().toString()
    assert "GreaterThan(id,90)" in plan and "StringStartsWith(s,9)" in plan


def _model(node, row):
    kind = node[0]
    if kind == "not":
        return not _model(node[1], row)
    if kind in ("and", "or"):
        a, b = _model(node[1], row), _model(node[2], row)
        return (a and b) if kind == "and" else (a or b)
    _, column, op, value = node
    cell = row[column]
    gone = cell is None or (isinstance(cell, float) and math.isnan(cell))
    if gone:
        return op == "!="
    return {"==": cell == value, "!=": cell != value, "<": cell < value, "<=": cell <= value,
            ">": cell > value, ">=": cell >= value}[op]


def _text(node):
    if node[0] == "not":
        return f"NOT ({_text(node[1])})"
    if node[0] in ("and", "or"):
        return f"({_text(node[1])}) {node[0].upper()} ({_text(node[2])})"
    return f"{node[1]} {node[2]} {node[3]}"


def test_random_predicates_match_a_plain_model(spark):
    rng = random.Random(7)

    def grow(depth):
        pick = rng.random()
        if depth == 0 or pick < 0.3:
            return ("cmp", rng.choice("ab"), rng.choice(["==", "!=", "<", "<=", ">", ">="]), rng.randint(0, 3))
        if pick < 0.5:
            return ("not", grow(depth - 1))
        return (rng.choice(["and", "or"]), grow(depth - 1), grow(depth - 1))

    values = [None, 0, 1, 2, 3]
    rows = [(a, None if b is None else float(b)) for a in values for b in values] + [(1, float("nan"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a bigint, b double").coalesce(1)
    trees = [grow(3) for _ in range(40)]
    got = df.select("i", *[mask(_text(t), df).alias(f"p{k}") for k, t in enumerate(trees)]).orderBy("i").collect()
    for i, (a, b) in enumerate(rows):
        for k, tree in enumerate(trees):
            assert got[i][f"p{k}"] == _model(tree, {"a": a, "b": b}), (_text(tree), rows[i])


PATTERNS = [
    "[[:alpha:]]+", "[[:^digit:]_]", "^[[:punct:]]$", "(?P<n>x)y", "(?<n>x)+?y", "a.b", "(?s)a.b", "^b$", "(?m)^b$", "(?m)^$", "b$", r"\bé", r"\Bé",
    r"\s", r"\S\s\S", "[^a-c\\d]", r"[\pL\d]+\z", r"[^\p{Lu}x]", r"\p{Greek}", r"\PL", "(?i)É|ß", "(?i:STRASSE)x", "a{,2}", "x{2}", "x{2,}y",
    r"\x{e9}", r"\x41", r"\101", r"\Qa.b\E+", "[]a]", "[a-]", "[&&b]", "[a[]", "(?U)x+?y", "a|b|", "(?:a|b)*c", r"\.", r"[\]\[^-]", "é|日", "(?i)[k]", r"\w+\W",
]


def test_patterns_mean_what_the_linear_engine_means(spark):
    """Every pattern on every text, against the engine whose meaning the language has."""
    texts = ["", "a", "b", "ab", "a\nb", "a\rb", "a\x85b", "a\u2028b", "b\n", "x\x0by", "xy", "xxy", "xxxy", "é", "É", "ée", "eé", " é", "a.b", "a.bb", "STRASSE", "strassex",
             "ß", "α", "日本", "1", "_", "-", "^", "]", "[", "&", "\\", "A", "a{,2}", "abc", "cab", "k", "K", "\u212a", "!", "x y", "a\n\nb", "\t", "\xa0", "Q.", "q1", "𝒳"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = {"contains": "{}", "match": r"\A(?:{})", "fullmatch": r"\A(?:{})\z"}
    odd = []
    for method, around in whole.items():
        shown = df.select("i", *[mask(f"t.str.{method}({p!r})", df).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).collect()
        for k, p in enumerate(PATTERNS):
            found = pc.match_substring_regex(pa.array(texts), around.replace("{}", p)).to_pylist()
            want = {i for i, f in enumerate(found) if f}
            got = {r.i for r in shown if r[f"p{k}"]}
            if got != want:
                odd.append((method, p, [texts[i] for i in got ^ want]))
    assert odd == []


def test_patterns_without_an_equivalent_are_refused(spark):
    df = spark.createDataFrame([("a",)], "t string")
    for pattern in (r"\C", "(?=a)", r"(a)\1", "a**", "["):
        with pytest.raises(PredicateError):
            condition(f"t.str.contains({pattern!r})", df)
