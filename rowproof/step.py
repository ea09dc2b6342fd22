"""What an operator returns: the lazy rows, and how each row came to be."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.ordinals import ORD, data_columns, number_kept, number_sorted
from rowproof.session import land

DIRECT, CONTRIBUTION = "direct", "contribution"

EDGE_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("parent_stage", T.StringType()),
    T.StructField("parent_ord", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_sha", T.StringType()),
])

# Builds contribution edges from (numbered rows, stage, parent stages).
Contributions = Callable[[DataFrame, str, Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Step:
    """`frame` holds the data columns plus reserved ones; `parents` names those with parent ordinals.

    `numbering` says what turns the rows into positions: `same` (already positions), `kept`
    (a subsequence of the first input) or `sorted` (by `order`). Nothing is numbered, and no
    edge is built, until `numbered` or `edges` is called.
    """

    frame: DataFrame
    parents: tuple[str, ...] = ()
    numbering: str = "same"
    order: tuple[Column, ...] = ()
    contributions: Contributions | None = None
    notes: tuple[str, ...] = ()
    landed: list[DataFrame] = field(default_factory=list, compare=False, repr=False)

    @property
    def rows(self) -> DataFrame:
        """The data columns alone."""
        return self.frame.select(*[f"`{c}`" for c in data_columns(self.frame)])

    def numbered(self) -> DataFrame:
        """Rows with dense positions in `_ord`, parent ordinals kept beside them."""
        if self.numbering == "same":
            return self.frame
        if not self.landed:
            if self.numbering == "kept":
                self.landed.append(number_kept(self.frame, self.parents[0], ORD))
            else:
                self.landed.append(number_sorted(self.frame, self.order, ORD))
        return self.landed[0]

    def stored(self) -> "Step":
        """The same rows, numbered and written once to the shared folder."""
        return Step(land(self.numbered(), "stage"), self.parents, "same", (), self.contributions, self.notes)

    def output(self) -> DataFrame:
        """Data columns and `_ord`: what the next step reads."""
        numbered = self.numbered()
        return numbered.select(*[f"`{c}`" for c in data_columns(numbered)], ORD)

    def edges(self, stage: str, *parent_stages: str) -> DataFrame:
        """One row per (output row, parent), the followed parent first."""
        numbered = self.numbered()
        parts = [
            edge_rows(numbered.where(F.col(column).isNotNull()), stage, position, parent, column)
            for position, (column, parent) in enumerate(zip(self.parents, parent_stages))
        ]
        if self.contributions is not None:
            parts.append(self.contributions(numbered, stage, parent_stages))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def with_notes(self, *notes: str) -> "Step":
        return replace(self, notes=self.notes + notes)


def edge_rows(df: DataFrame, stage: str, position: int, parent: str, parent_ord: str,
              kind: str = DIRECT, columns: Column | None = None) -> DataFrame:
    nothing = F.lit(None)
    return df.select(
        F.lit(stage).alias("stage"), F.col(ORD).cast("bigint").alias("ord"),
        F.lit(position).cast("int").alias("pos"), F.lit(parent).alias("parent_stage"),
        F.col(parent_ord).cast("bigint").alias("parent_ord"), F.lit(kind).alias("kind"),
        (nothing if columns is None else columns).cast("array<string>").alias("columns"),
        nothing.cast("string").alias("source_file"), nothing.cast("string").alias("source_sha"))
