"""The compact `where` language, turned into Spark columns.

A predicate is two-valued: a comparison with an absent value is false, `!=` with an absent
value is true, and NOT flips that answer. `condition()` returns a column that is TRUE exactly
where the predicate holds and false-or-null elsewhere, which is all a filter or a `when`
needs; keeping plain comparisons there (no coalesce) lets Catalyst push them into the scan.
`mask()` is the same test with every null replaced by false.
"""
from __future__ import annotations

import ast
import re
from collections.abc import Collection

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import PredicateError
from rowproof.functions.regex import engine_pattern

_TOKEN = re.compile(
    r"""(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""
    r"|`(?P<quoted>[^`]*)`"
    r"|(?P<missing>\bIS\s+NULL\b)"
    r"|(?P<present>\bIS\s+NOT\s+NULL\b)"
    r"|(?P<word>[A-Za-z_]\w*)"
    r"|(?P<amp>&)|(?P<bar>\|)",
)
_WORDS = {"AND": "and", "OR": "or", "NOT": "not"}
_TRUTH = {"true": "True", "false": "False"}

_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_FLIPPED = {"==": "!=", "!=": "==", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}

# The string tests of the language and the pattern each one stands for.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_STRING_CLASSES = {
    "isalnum": r"\A[\p{L}\p{N}]+\z",
    "isalpha": r"\A\p{L}+\z",
    "isascii": r"\A[\x00-\x7F]*\z",
    "isdecimal": r"\A\p{Nd}+\z",
    "isdigit": r"\A[\p{Nd}²³¹⁰-⁹₀-₉]+\z",
    "isnumeric": r"\A\p{N}+\z",
    "isspace": r"\A[\s\x1C-\x1F\x85\p{Z}]+\z",
}
_STRING_TESTS = {"islower", "isupper", "istitle"}
_REGEX_TESTS = {"contains", "match", "fullmatch"}
_AFFIX_TESTS = {"startswith", "endswith"}
_PLAIN_PATTERN = re.compile(r"[\w \-,:;@#%&=!<>/'\"~]*\Z")


def condition(text: str, df: DataFrame) -> Column:
    """TRUE where the predicate holds; false or null elsewhere."""
    compiler = _Compiler(text, df.schema)
    return compiler.holds(compiler.tree, wanted=True)


def mask(text: str, df: DataFrame) -> Column:
    return F.coalesce(condition(text, df), F.lit(False))


def columns_read(text: str, columns: Collection[str] = ()) -> set[str]:
    """The columns a predicate reads. A backticked name must be one of `columns`."""
    tree, quoted = _parse(text, columns)
    return {quoted.get(n.id, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name)}


def check_regex(pattern: str) -> None:
    """Refuse a pattern that needs backtracking: it must compile as a linear-time automaton."""
    try:
        pc.count_substring_regex(pa.array(["x"]), pattern)
    except pa.ArrowInvalid as error:
        raise PredicateError(f"the pattern {pattern!r} cannot be searched for: {error}") from error


def absent(column: Column, dtype: T.DataType) -> Column:
    """Null, and NaN where the column can hold one: both are the same absence."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def present_value(column: Column, dtype: T.DataType) -> Column:
    """The value with NaN read as null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _parse(text: str, columns: Collection[str]) -> tuple[ast.expr, dict[str, str]]:
    quoted: dict[str, str] = {}
    stem = "q_"
    while stem in text:
        stem += "_"

    def rewrite(match: re.Match[str]) -> str:
        kind, found = match.lastgroup, match.group()
        if kind == "quoted":
            column = match.group("quoted")
            if column not in columns:
                raise PredicateError(
                    f"`{column}` in {text!r} is not a column here; this reads {sorted(columns)}")
            alias = f"{stem}{len(quoted)}_"
            quoted[alias] = column
            return alias
        if kind == "missing":
            return ".isna()"
        if kind == "present":
            return ".notna()"
        if kind == "word":
            return _WORDS.get(found) or _TRUTH.get(found.lower()) or found
        return {"amp": " and ", "bar": " or "}.get(kind or "", found)

    source = _TOKEN.sub(rewrite, text).strip()
    try:
        return ast.parse(source, mode="eval").body, quoted
    except (SyntaxError, ValueError) as error:
        raise PredicateError(
            f"{text!r} is not a filter this language reads ({error}); a column whose name "
            "holds a space is written in backticks") from error


class _Compiler:
    def __init__(self, text: str, schema: T.StructType) -> None:
        self.text = text
        self.types = {field.name: field.dataType for field in schema.fields}
        self.tree, self.quoted = _parse(text, self.types)
        unknown = sorted(columns_read(text, self.types) - set(self.types))
        if unknown:
            raise PredicateError(
                f"{text!r} reads {unknown}, which are not columns here: {sorted(self.types)}")

    # `wanted` carries NOT downwards, so each leaf states when it is true or when it is false.
    def holds(self, node: ast.expr, wanted: bool) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.holds(value, wanted) for value in node.values]
            both = isinstance(node.op, ast.And) == wanted
            whole = parts[0]
            for part in parts[1:]:
                whole = (whole & part) if both else (whole | part)
            return whole
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return self.holds(node.operand, not wanted)
        if isinstance(node, ast.Compare):
            return self._comparison(node, wanted)
        if isinstance(node, ast.Call):
            return self._call(node, wanted)
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value == wanted)
        if isinstance(node, ast.Name):
            column, dtype = self._operand(node)
            if isinstance(dtype, T.BooleanType):
                return column if wanted else ~F.coalesce(column, F.lit(False))
        raise self._refused(node)

    def _refused(self, node: ast.AST) -> PredicateError:
        return PredicateError(
            f"{self.text!r}: {type(node).__name__} is not a test this language has; it compares "
            "columns and values, joins tests with AND, OR and NOT, and knows IS NULL and .str tests")

    def _operand(self, node: ast.expr) -> tuple[Column, T.DataType | None]:
        if isinstance(node, ast.Name):
            column = self.quoted.get(node.id, node.id)
            return name(column), self.types[column]
        if isinstance(node, ast.Constant) and (
                node.value is None or isinstance(node.value, (bool, int, float, str))):
            return F.lit(node.value), None
        raise self._refused(node)

    def _comparison(self, node: ast.Compare, wanted: bool) -> Column:
        sides = [node.left, *node.comparators]
        links = []
        for left, op, right in zip(sides, node.ops, sides[1:]):
            if type(op) not in _COMPARE:
                raise self._refused(op)
            links.append(self._link(left, _COMPARE[type(op)], right, wanted))
        whole = links[0]
        for link in links[1:]:
            whole = (whole & link) if wanted else (whole | link)
        return whole

    def _link(self, left: ast.expr, op: str, right: ast.expr, wanted: bool) -> Column:
        (a, a_type), (b, b_type) = self._operand(left), self._operand(right)
        if self._incomparable(left, a_type, right, b_type):
            if op not in ("==", "!="):
                raise PredicateError(f"{self.text!r} orders text against a number")
            return F.lit((op == "!=") == wanted)
        # `!=`, or any comparison that must fail, also holds where a side is absent.
        or_absent = (op == "!=") == wanted
        shown = op if wanted else _FLIPPED[op]
        test = {
            "==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b,
        }[shown]
        # NaN sorts above every number, so it must be kept off the greater side and out of ==.
        guarded = {"<": (False, True), "<=": (False, True), ">": (True, False), ">=": (True, False)}
        for column, dtype, guard in zip((a, b), (a_type, b_type), guarded.get(shown, (True, True))):
            if dtype is None:
                continue
            if or_absent:
                test = test | absent(column, dtype)
            elif isinstance(dtype, (T.DoubleType, T.FloatType)) and guard:
                # Said as a bound, which the scan accepts where it would not accept isnan.
                test = test & (column <= F.lit(float("inf")))
        return test

    @staticmethod
    def _incomparable(left: ast.expr, a: T.DataType | None,
                      right: ast.expr, b: T.DataType | None) -> bool:
        def family(node: ast.expr, dtype: T.DataType | None) -> str:
            if dtype is None:
                value = getattr(node, "value", None)
                if isinstance(value, str):
                    return "text"
                return "number" if isinstance(value, (int, float)) else "any"
            if isinstance(dtype, T.StringType):
                return "text"
            if isinstance(dtype, (T.NumericType, T.BooleanType)):
                return "number"
            return "any"
        return {family(left, a), family(right, b)} == {"text", "number"}

    def _call(self, node: ast.Call, wanted: bool) -> Column:
        if node.keywords or not isinstance(node.func, ast.Attribute):
            raise self._refused(node)
        method, owner = node.func.attr, node.func.value
        if method in ("isna", "notna") and not node.args:
            column, dtype = self._operand(owner)
            gone = column.isNull() if dtype is None else absent(column, dtype)
            return gone if (method == "isna") == wanted else ~gone
        if not (isinstance(owner, ast.Attribute) and owner.attr == "str"):
            raise self._refused(node)
        column, dtype = self._operand(owner.value)
        if not isinstance(dtype, T.StringType):
            raise PredicateError(f"{self.text!r}: .str tests need a text column")
        test = self._string_test(column, method, node)
        return test if wanted else ~F.coalesce(test, F.lit(False))

    def _string_test(self, column: Column, method: str, node: ast.Call) -> Column:
        if method in _STRING_CLASSES and not node.args:
            return column.rlike(_STRING_CLASSES[method])
        if method in _STRING_TESTS and not node.args:
            upper, lower = column.rlike(r"[\p{Lu}\p{Lt}]"), column.rlike(r"\p{Ll}")
            if method == "islower":
                return lower & ~upper
            if method == "isupper":
                return column.rlike(r"\p{Lu}") & ~column.rlike(r"[\p{Ll}\p{Lt}]")
            return (upper & ~column.rlike(rf"[{_CASED}][\p{{Lu}}\p{{Lt}}]")
                    & ~column.rlike(rf"(?:\A|[^{_CASED}])\p{{Ll}}"))
        if method in _REGEX_TESTS | _AFFIX_TESTS and len(node.args) == 1:
            argument = node.args[0]
            if not (isinstance(argument, ast.Constant) and isinstance(argument.value, str)):
                raise self._refused(argument)
            return self._pattern_test(column, method, argument.value)
        raise self._refused(node)

    @staticmethod
    def _pattern_test(column: Column, method: str, pattern: str) -> Column:
        if method == "startswith":
            return column.startswith(pattern)
        if method == "endswith":
            return column.endswith(pattern)
        check_regex(pattern)
        # A pattern without metacharacters is a plain text test, which the scan can take over.
        if _PLAIN_PATTERN.match(pattern):
            if method == "contains":
                return column.contains(pattern)
            return column.startswith(pattern) if method == "match" else column == F.lit(pattern)
        translated = engine_pattern(pattern)
        if method == "contains":
            return column.rlike(translated)
        return column.rlike(rf"\A(?:{translated})" + (r"\z" if method == "fullmatch" else ""))
