"""Published values checked against the cells they cite."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import CitationMismatch
from rowproof.functions.predicate import name
from rowproof.functions.text import cell_text
from rowproof.ordinals import ORD, data_columns

CLAIMS = "stage string, ord bigint, column string, value string, label string"


def check_citations(claims: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Each claim with what its cell holds, and a status: ok, mismatch, no_row, no_column or no_stage.

    A claim without a column cites the row as a whole. A claimed absence matches an absent cell.
    Claims meet only the rows and columns they name.
    """
    pairs = claims.select("stage", "column").distinct().collect()
    cited: dict[str, list[str]] = {}
    for row in pairs:
        cited.setdefault(row["stage"], [])
        if row["column"] is not None:
            cited[row["stage"]].append(row["column"])
    parts = [claims.where(~F.col("stage").isin([s for s in cited if s in tables])).select(
        "*", F.lit(None).cast("string").alias("held"), F.lit("no_stage").alias("status"))]
    for stage, columns in cited.items():
        if stage in tables:
            parts.append(_checked(claims.where(F.col("stage") == stage), tables[stage], sorted(columns)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _checked(claims: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    known = [c for c in columns if c in data_columns(table)]
    numeric = [c for c in known if isinstance(table.schema[c].dataType, T.NumericType)]
    cells = table.select(F.col(ORD).alias("ord"), F.lit(True).alias("_found"), *[
        cell_text(name(c), table.schema[c].dataType).alias(f"_c{i}") for i, c in enumerate(known)])
    joined = claims.join(cells, "ord", "left")
    held = F.lit(None).cast("string")
    for i, c in enumerate(known):
        held = F.when(F.col("column") == c, F.col(f"_c{i}")).otherwise(held)
    joined = joined.withColumn("held", held)
    # Numbers compare as numbers, so a claim of 5 meets a cell of 5.0.
    as_number = F.col("column").isin(numeric) & (
        F.col("value").try_cast("double") == F.col("held").try_cast("double"))
    matches = F.col("value").eqNullSafe(F.col("held")) | F.coalesce(as_number, F.lit(False))
    status = (F.when(F.col("_found").isNull(), "no_row")
              .when(F.col("column").isNull(), "ok")
              .when(~F.col("column").isin(known), "no_column")
              .when(matches, "ok").otherwise("mismatch"))
    return joined.select(*claims.columns, "held", status.alias("status"))


def require_citations(claims: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The checked claims, or a refusal naming the first few that do not hold."""
    checked = check_citations(claims, tables)
    bad = checked.where(F.col("status") != "ok").orderBy("stage", "ord", "column").limit(5).collect()
    if bad:
        raise CitationMismatch("; ".join(
            f"{r['label']!r} cites {r['stage']}.{r['column']} row {r['ord']} for {r['value']!r}, "
            f"but it holds {r['held']!r} ({r['status']})" for r in bad))
    return checked


class Citations:
    """Handed to a publishing function: what it cites is checked as it is said, and kept."""

    def __init__(self, tables: Mapping[str, DataFrame]) -> None:
        self._tables = dict(tables)
        self._said: list[DataFrame] = []

    def cite(self, claims: DataFrame) -> DataFrame:
        """Refuses unless every cited cell holds the value claimed for it."""
        checked = require_citations(claims, self._tables)
        self._said.append(checked.withColumn("claim", F.lit(len(self._said))))
        return checked

    def said(self) -> DataFrame | None:
        """All claims made, in the order they were made."""
        whole: DataFrame | None = None
        for part in self._said:
            whole = part if whole is None else whole.unionByName(part)
        return whole


def publish_with(fn: Callable[..., DataFrame], tables: Mapping[str, DataFrame],
                 destination: str) -> tuple[DataFrame, DataFrame | None]:
    """Run an authored publishing function over whole tables, in order.

    `fn` takes the tables, `output_dir` to write artifacts under and `citations` to cite by; it
    returns a table. What it cited comes back beside its result.
    """
    citations = Citations(tables)
    made = fn(*tables.values(), output_dir=destination, citations=citations)
    if not isinstance(made, DataFrame):
        raise TypeError(f"a publishing function returned {type(made).__name__}, not a DataFrame")
    return made, citations.said()


def cited_rows(claims: DataFrame, order: str = "claim") -> DataFrame:
    """Each cited row once: rows cited for a value first, then rows cited whole, in claim order."""
    rank = F.struct(F.col("column").isNull().alias("whole"), F.col(order).alias("at"))
    return (claims.groupBy("stage", "ord").agg(F.min(rank).alias("_rank"))
            .orderBy("_rank").select("stage", "ord"))
