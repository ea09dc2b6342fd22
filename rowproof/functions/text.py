"""Cells as text, canonical row JSON, fingerprints and message templates."""
from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError
from rowproof.functions.predicate import absent, name

_REALS = (T.DoubleType, T.FloatType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def plain_number(column: Column) -> Column:
    """A double as its shortest decimal text: fixed notation from 1e-4 up to 1e16."""
    shown = column.cast("string")
    size = F.abs(column)
    fixed = F.regexp_replace(
        F.regexp_replace(
            shown.try_cast("decimal(38,21)").cast("string"),
            r"0+$", ""),
        r"\.$", ".0")
    exponent = F.regexp_extract(shown, r"E(-?)(\d+)$", 2)
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(shown, r"^(.*)E", 1), r"\.0$", ""), F.lit("e"),
        F.when(F.regexp_extract(shown, r"E(-?)\d+$", 1) == "-", F.lit("-")).otherwise(F.lit("+")),
        F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent))
    return (F.when(~shown.contains("E"), shown)
            .when((size >= 1e-4) & (size < 1e16), fixed)
            .otherwise(scientific))


def cell_text(column: Column, dtype: T.DataType) -> Column:
    """One cell as the text a reader sees; null for an absent value."""
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, _REALS):
        return F.when(~F.isnan(column), plain_number(column))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(dtype, _TIMES):
        shown = column.cast("string")
        fraction = F.regexp_extract(shown, r"\.(\d+)$", 1)
        return F.when(fraction == "", shown).otherwise(
            F.concat(F.substring(shown, 1, 20), F.rpad(fraction, 6, "0")))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def render_text(df: DataFrame) -> DataFrame:
    """Every data cell as text, an absent value as the empty text."""
    return df.select(*[
        name(f.name) if f.name.startswith("_") else
        F.coalesce(cell_text(name(f.name), f.dataType), F.lit("")).alias(f.name)
        for f in df.schema.fields])


# Texts with at most this many distinct characters outside ASCII are escaped by whole-text
# replacements, one per character; richer ones character by character.
_FEW = 64


def _escaped(column: Column) -> Column:
    """A JSON string of ASCII characters only; ASCII texts skip the escaping."""
    # A one-element array holds the string in brackets; its quotes stop the trim.
    quoted = F.btrim(F.to_json(F.array(column)), F.lit("[]"))

    def unit(value: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(value)), 4, "0"))

    def character(c: Column) -> Column:
        point = F.ascii(c)
        above = (point - 0x10000).cast("long")
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800),
                        unit(above.bitwiseAND(0x3FF) + 0xDC00))
        return F.when(point < 0x80, c).when(point < 0x10000, unit(point)).otherwise(pair)

    distinct = F.array_distinct(F.split(F.regexp_replace(column, r"[\x00-\x7F]+", ""), ""))
    by_text = F.reduce(distinct, quoted, lambda text, c: F.replace(text, c, character(c)))
    by_character = F.array_join(F.transform(F.split(quoted, ""), character), "")
    return (F.when(F.length(column) == F.octet_length(column), quoted)
            .when(F.size(distinct) <= _FEW, by_text).otherwise(by_character))


def json_cell(column: Column, dtype: T.DataType) -> Column:
    """One cell as canonical JSON: absent as null, names sorted, no spaces."""
    if isinstance(dtype, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(
            F.transform(column, lambda x: json_cell(x, dtype.elementType)), ","), F.lit("]"))
    elif isinstance(dtype, T.StructType):
        shown = json_row({f.name: (column[f.name], f.dataType) for f in dtype.fields})
    elif isinstance(dtype, T.MapType):
        shown = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
    elif isinstance(dtype, T.BooleanType):
        shown = column.cast("string")
    elif isinstance(dtype, _REALS):
        shown = (F.when(column == float("inf"), F.lit("Infinity"))
                 .when(column == float("-inf"), F.lit("-Infinity")).otherwise(plain_number(column)))
    elif isinstance(dtype, T.IntegralType):
        shown = column.cast("string")
    else:
        shown = _escaped(cell_text(column, dtype))
    return F.when(absent(column, dtype), F.lit("null")).otherwise(shown)


def json_row(cells: dict[str, tuple[Column, T.DataType]], in_order: bool = False) -> Column:
    names = list(cells) if in_order else sorted(cells)
    parts: list[Column] = []
    for position, key in enumerate(names):
        lead = "{" if position == 0 else ","
        parts += [F.lit(f"{lead}{json.dumps(key)}:"), json_cell(*cells[key])]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def short_hash(column: Column) -> Column:
    return F.substring(F.sha1(column.cast("binary")), 1, 16)


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    columns = [c for c in df.columns if not c.startswith("_")] if columns is None else columns
    return json_row({c: (name(c), df.schema[c].dataType) for c in columns})


def row_fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """16 hex digits naming a row by content; column order and null forms do not change it."""
    return short_hash(canonical_json(df, columns))


def template_fields(template: str) -> set[str]:
    found = set()
    for _, field, _, _ in string.Formatter().parse(template):
        base = re.split(r"[.\[]", field, maxsplit=1)[0] if field else ""
        if base and not base.isdigit():
            found.add(base)
    return found


def escaped_columns(template: str, columns: list[str]) -> list[str]:
    """Columns written in double braces, which render as literal braces and never substitute."""
    return sorted(c for c in columns
                  if "{{" + c + "}}" in template and c not in template_fields(template))


def render_template(df: DataFrame, template: str) -> Column:
    """`{column}` filled from the row; `{{` and `}}` are literal braces. Parsed once, on the driver."""
    parts: list[Column] = []
    for text, field, spec, conversion in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is None:
            continue
        if field not in df.columns:
            raise ContractError(
                f"the template names {{{field}}}, which is not a column; write {{{{ }}}} for braces")
        if conversion:
            raise ContractError(f"{{{field}!{conversion}}}: conversions are not rendered")
        column, dtype = name(field), df.schema[field].dataType
        if spec:
            if not re.fullmatch(r",?(\.\d+f)?", spec):
                raise ContractError(f"{{{field}:{spec}}}: only fixed-point formats are rendered")
            shown = F.format_string(f"%{spec if spec != ',' else ',d'}", column)
        else:
            shown = cell_text(column, dtype)
        parts.append(F.coalesce(shown, F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")
