"""Declared tables: columns with a type, nullability, range, vocabulary and shape.

A contract is checked on the driver against column specs alone, before any job starts.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import types as T

from rowproof.errors import ContractError

SCALARS: dict[str, T.DataType] = {
    "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(),
    "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "date": T.DateType(),
}
DATES = ("date", "datetime")


def list_element(type_name: str) -> str | None:
    if type_name.startswith("list[") and type_name.endswith("]"):
        return type_name[5:-1].strip()
    return None


def _known(type_name: str, depth: int = 0) -> bool:
    inner = list_element(type_name)
    if inner is not None:
        return depth < 2 and _known(inner, depth + 1)
    return type_name in SCALARS or type_name == "json"


@dataclass(frozen=True)
class Col:
    name: str
    type: str
    nullable: bool = True
    range: tuple[Any, Any] | None = None
    enum: tuple[str, ...] | None = None
    fields: tuple["Col", ...] | None = None
    value_type: str | None = None
    references: str | None = None
    description: str | None = None

    def __post_init__(self) -> None:
        for attribute in ("range", "enum", "fields"):
            value = getattr(self, attribute)
            if isinstance(value, list):
                object.__setattr__(self, attribute, tuple(value))
        if not _known(self.type):
            raise ContractError(f"column {self.name!r}: unknown type {self.type!r}")
        if self.enum is not None and (self.type != "str" or not self.enum):
            raise ContractError(f"column {self.name!r}: a vocabulary needs type str and a value")
        if self.type in ("json", "list[json]"):
            if (self.fields is None) == (self.value_type is None):
                raise ContractError(
                    f"column {self.name!r}: declare either fields or value_type")
            if self.value_type is not None and self.value_type not in SCALARS:
                raise ContractError(f"column {self.name!r}: value_type must be a scalar type")
        elif self.fields is not None or self.value_type is not None:
            raise ContractError(f"column {self.name!r}: a shape belongs to json columns")
        if self.range is not None:
            if self.type not in ("int", "float"):
                raise ContractError(f"column {self.name!r}: a range belongs to a number")
            if len(self.range) != 2 or not all(
                    ("inf" in b) if isinstance(b, str) else
                    isinstance(b, (int, float)) and not isinstance(b, bool) for b in self.range):
                raise ContractError(f"column {self.name!r}: a range is [low, high]")

    @property
    def bounds(self) -> tuple[float | None, float | None]:
        if self.range is None:
            return None, None
        low, high = (None if isinstance(b, str) else b for b in self.range)
        return low, high

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self.type, self)

    def differences(self, other: "Col") -> list[str]:
        """Spec attributes on which two columns differ; name and prose do not count."""
        found = []
        for spec in fields(self):
            if spec.name in ("name", "description", "references"):
                continue
            mine, theirs = getattr(self, spec.name), getattr(other, spec.name)
            if spec.name == "fields" and mine and theirs:
                same = (len(mine) == len(theirs) and {c.name for c in mine} == {c.name for c in theirs}
                        and not any(a.differences(b) for a in mine for b in theirs if a.name == b.name))
                if not same:
                    found.append(spec.name)
            elif mine != theirs:
                found.append(spec.name)
        return found


def spark_type(type_name: str, column: Col) -> T.DataType:
    inner = list_element(type_name)
    if inner is not None:
        return T.ArrayType(spark_type(inner, column))
    if type_name == "json":
        if column.value_type is not None:
            return T.MapType(T.StringType(), SCALARS[column.value_type])
        return T.StructType([T.StructField(f.name, f.spark_type) for f in column.fields or ()])
    return SCALARS[type_name]


def declared_type(dtype: T.DataType) -> str:
    """The vocabulary's name for a Spark type."""
    if isinstance(dtype, T.ArrayType):
        return f"list[{declared_type(dtype.elementType)}]"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "json"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    for label, candidate in SCALARS.items():
        if isinstance(dtype, type(candidate)):
            return label
    raise ContractError(f"{dtype.simpleString()} has no declared type")


@dataclass(frozen=True)
class Table:
    columns: tuple[Col, ...] = ()
    name: str | None = None
    primary_key: tuple[str, ...] = ()
    kind: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "primary_key", tuple(self.primary_key))
        names = [c.name for c in self.columns]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ContractError(f"columns declared twice: {repeated}")
        unknown = [k for k in self.primary_key if k not in names]
        if unknown:
            raise ContractError(f"primary key names undeclared columns {unknown}")

    @classmethod
    def of(cls, *columns: Col) -> "Table":
        return cls(columns)

    @classmethod
    def from_spark(cls, schema: T.StructType) -> "Table":
        made = []
        for f in schema.fields:
            if f.name.startswith("_"):
                continue
            kind = declared_type(f.dataType)
            shape: dict[str, Any] = {}
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                shape["fields"] = cls.from_spark(inner).columns
            elif isinstance(inner, T.MapType):
                shape["value_type"] = declared_type(inner.valueType)
            made.append(Col(f.name, kind, f.nullable, **shape))
        return cls(tuple(made))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def get(self, column: str) -> Col | None:
        return next((c for c in self.columns if c.name == column), None)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, c.nullable) for c in self.columns])

    def extend(self, rewrites: Sequence[Col] = (), adds: Sequence[Col] = ()) -> "Table":
        swapped = {c.name: c for c in rewrites}
        unknown = sorted(set(swapped) - set(self.names))
        taken = sorted({c.name for c in adds} & set(self.names))
        if unknown or taken:
            raise ContractError(
                f"rewrites name absent columns {unknown}; adds name existing columns {taken}")
        return Table(tuple(swapped.get(c.name, c) for c in self.columns) + tuple(adds))

    def subtract(self, other: "Table", strict: bool = True) -> "Table":
        if strict:
            problems = other.unmet_by(self, exact=True)
            if problems:
                raise ContractError("cannot subtract: " + "; ".join(problems))
        return Table(tuple(
            c for c in self.columns
            if other.get(c.name) is None or c.differences(other.get(c.name))))  # type: ignore[arg-type]

    def differing(self, other: "Table") -> set[str]:
        mine, theirs = {c.name: c for c in self.columns}, {c.name: c for c in other.columns}
        return {n for n in {*mine, *theirs}
                if n not in mine or n not in theirs or mine[n].differences(theirs[n])}

    def unmet_by(self, producer: "Table", exact: bool = False) -> list[str]:
        """Why `producer` cannot supply this table; empty when it can.

        Unless `exact`, a nullable consumer takes a non-null producer.
        """
        reasons = []
        for wanted in self.columns:
            given = producer.get(wanted.name)
            if given is None:
                reasons.append(f"column {wanted.name!r} is absent from the producer")
                continue
            differs = wanted.differences(given)
            if not exact and "nullable" in differs and wanted.nullable:
                differs.remove("nullable")
            if differs:
                reasons.append(f"column {wanted.name!r} differs on {', '.join(differs)}")
        return reasons

    def is_subset_of(self, other: "Table") -> bool:
        return not self.unmet_by(other, exact=True)


@dataclass(frozen=True)
class Signature:
    """What a step reads and writes: it extends its first input, or replaces it outright."""

    reads: dict[str, Table] = field(default_factory=dict)
    rewrites: tuple[Col, ...] = ()
    adds: tuple[Col, ...] = ()
    produces: Table | None = None

    def check(self, inputs: dict[str, Table]) -> None:
        problems = []
        for label, wanted in self.reads.items():
            if label not in inputs:
                problems.append(f"input {label!r} is not given")
                continue
            problems += [f"input {label!r}: {r}" for r in wanted.unmet_by(inputs[label])]
        if self.produces is not None and (self.rewrites or self.adds):
            problems.append("a step either extends its input or produces its own columns")
        reserved = sorted(c.name for c in (*self.adds, *(self.produces.columns if self.produces else ()))
                          if c.name.startswith("_"))
        if reserved:
            problems.append(f"names beginning with _ are reserved: {reserved}")
        if problems:
            raise ContractError("; ".join(problems))

    def output(self, inputs: dict[str, Table]) -> Table:
        self.check(inputs)
        if self.produces is not None:
            return self.produces
        anchor = next(iter(inputs.values()), Table())
        return anchor.extend(self.rewrites, self.adds)


def nullable(column: Col, name: str | None = None) -> Col:
    return replace(column, nullable=True, name=name or column.name)


# ── types of one column in several inputs ──────────────────────────────────

_WIDER = ("void", "int", "bigint", "float", "double")


def promoted(types: Sequence[T.DataType], column: str) -> T.DataType:
    """The type a concatenated column takes: all-null gives way, integers join doubles."""
    distinct = list(dict.fromkeys(t.simpleString() for t in types))
    by_name = {t.simpleString(): t for t in types}
    real = [d for d in distinct if d != "void"]
    if len(real) <= 1:
        return by_name[real[0]] if real else T.NullType()
    if all(d in _WIDER for d in real):
        return by_name[max(real, key=_WIDER.index)]
    raise ContractError(f"column {column!r} is {' in one input and '.join(real)} in another")
