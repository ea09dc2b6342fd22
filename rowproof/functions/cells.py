"""Values that authored code or a reply wrote, as typed columns; a value that does not fit is a fault of its row."""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

import pyarrow as pa

_UNWRITTEN = object()


def _fault(column: str, value: Any, kind: pa.DataType) -> str:
    shown = repr(value)
    if len(shown) > 80:
        shown = f"{shown[:77]}..."
    return f"{column}: {shown} ({type(value).__name__}) is no {kind}"


def _misfit(value: Any, kind: pa.DataType) -> bool:
    """What Arrow would take silently: fractions cut to integers, truth values as numbers and the reverse."""
    if value is None:
        return False
    if pa.types.is_integer(kind):
        return isinstance(value, bool) or isinstance(value, float) and not value.is_integer()
    if pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        return isinstance(value, bool)
    if pa.types.is_boolean(kind):
        return not isinstance(value, bool)
    if pa.types.is_list(kind):
        return isinstance(value, (list, tuple)) and any(_misfit(v, kind.value_type) for v in value)
    if pa.types.is_struct(kind):
        return isinstance(value, Mapping) and any(_misfit(value.get(f.name), f.type) for f in kind)
    if pa.types.is_map(kind):
        return isinstance(value, Mapping) and any(_misfit(v, kind.item_type) for v in value.values())
    return False


def _typed(values: Sequence[Any], kind: pa.DataType) -> pa.Array:
    plain = {int: pa.types.is_integer, float: pa.types.is_floating, str: pa.types.is_string}
    met = set(map(type, values)) - {type(None)}
    if not all(t in plain and plain[t](kind) for t in met) and any(_misfit(v, kind) for v in values):
        raise pa.ArrowInvalid("a value of another type than declared")
    return pa.array(values, type=kind)


def written_column(values: Sequence[Any], field: pa.Field) -> tuple[pa.Array, dict[int, str]]:
    """The column, and what is wrong with it by row; a wrong or unwritten value is null.

    The whole column is converted at once; only where that fails is it gone through value by value.
    """
    unwritten = {i: f"{field.name}: not written" for i, v in enumerate(values) if v is _UNWRITTEN}
    plain = [None if v is _UNWRITTEN else v for v in values] if unwritten else values
    try:
        return _typed(plain, field.type), unwritten
    except (pa.ArrowException, TypeError, ValueError, OverflowError, AttributeError):
        pass
    faults, kept = dict(unwritten), list(plain)
    for i, value in enumerate(plain):
        try:
            _typed([value], field.type)
        except (pa.ArrowException, TypeError, ValueError, OverflowError, AttributeError):
            faults[i], kept[i] = _fault(field.name, value, field.type), None
    return _typed(kept, field.type), faults


def written_columns(rows: Sequence[Mapping[str, Any] | None], fields: Iterable[pa.Field]) -> tuple[list[pa.Array], list[str | None]]:
    """A column per field from rows of written values, and per row all that is wrong with it, or null.

    A row that is None wrote nothing for a reason that stands elsewhere: its values are null and it has no fault.
    """
    columns, faults = [], [[] for _ in rows]
    for field in fields:
        values = [None if row is None else row.get(field.name, _UNWRITTEN) for row in rows]
        column, wrong = written_column(values, field)
        columns.append(column)
        for i, text in wrong.items():
            faults[i].append(text)
    return columns, ["; ".join(f) or None for f in faults]
