"""What a text file is, from one job over all files of a table: encoding, quotes that span lines, separator, broken lines."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowproof.errors import ContractError

SEPARATORS = {",": "commas", "\t": "tabs"}


@dataclass(frozen=True)
class TextFile:
    """One path: its encoding, whether a quoted cell spans lines, and what separates its columns."""

    western: bool
    multi_line: bool
    separator: str


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """value, _path_no, _file and _place: lines of a file in the order of their places."""
    parts = [spark.read.text(path).select("value", F.lit(i).alias("_path_no"), F.col("_metadata.file_path").alias("_file"),
                                          F.struct(F.col("_metadata.file_block_start").alias("block"),
                                                   F.monotonically_increasing_id().alias("at")).alias("_place"))
             for i, path in enumerate(paths)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def line_number(lines: DataFrame, path_no: int, file: str, place) -> int:
    """The 1-based number of a line in its file; counted only when a refusal names it."""
    within = lines.where((F.col("_path_no") == path_no) & (F.col("_file") == file))
    return within.where(F.col("_place") <= F.struct(F.lit(place["block"]).alias("block"), F.lit(place["at"]).alias("at"))).count()


def fields(line: Column, separator: str) -> Column:
    """How many cells a line of balanced quotes has."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def survey_separated(spark: SparkSession, paths: Sequence[str], separators: Sequence[str | None]) -> list[TextFile]:
    """One TextFile per path; a separator that is given is kept, otherwise it is the one that fits all lines.

    Every line of every file is measured. Lines are grouped by their widths before anything moves, so what
    remains is a few rows a file. A line with more cells than its file's header is refused by its number.
    """
    lines = numbered_lines(spark, paths)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    widths = [fields(F.col("value"), s).alias(f"w{i}") for i, s in enumerate(SEPARATORS)]
    measured = (lines.where(F.trim("value") != "")
                .select("_path_no", "_file", "_place", *widths, (~F.is_valid_utf8("value")).alias("western"), (quotes % 2 == 1).alias("odd"))
                .groupBy("_path_no", "_file", "w0", "w1")
                .agg(F.min("_place").alias("first"), F.bool_or("western").alias("western"), F.bool_or("odd").alias("odd")))
    file = W.partitionBy("_path_no", "_file")
    headed = measured.select("*", F.min_by(F.struct("w0", "w1"), "first").over(file).alias("head"))
    figures = [F.bool_or("western").alias("western"), F.bool_or("odd").alias("odd"), F.first("head").alias("head")]
    for i in range(len(SEPARATORS)):
        width, head = F.col(f"w{i}"), F.col("head")[f"w{i}"]
        figures += [F.bool_and(width == head).alias(f"steady{i}"),
                    F.min(F.when(width > head, F.struct("first", width.alias("width")))).alias(f"wide{i}")]
    found = headed.groupBy("_path_no", "_file").agg(*figures).collect()
    out = []
    for number, (path, given) in enumerate(zip(paths, separators)):
        here = sorted((r for r in found if r["_path_no"] == number), key=lambda r: r["_file"])
        odd = any(r.odd for r in here)
        separator = given or _separator(path, here, odd)
        if not odd and separator in SEPARATORS:
            at = list(SEPARATORS).index(separator)
            for r in here:
                if r[f"wide{at}"] is not None:
                    line = line_number(lines, number, r["_file"], r[f"wide{at}"]["first"])
                    raise ContractError(f"{r['_file'].rsplit('/', 1)[-1]}: line {line} has {r[f'wide{at}']['width']} cells, "
                                        f"its header {r['head'][f'w{at}']}")
        out.append(TextFile(any(r.western for r in here), odd, separator))
    return out


def _separator(path: str, files: Sequence, odd: bool) -> str:
    """The separator that gives every file's header several cells; of two, the one that fits every line."""
    several = [s for i, s in enumerate(SEPARATORS) if files and all(r["head"][f"w{i}"] > 1 for r in files)]
    if len(several) > 1:
        several = [s for i, s in enumerate(SEPARATORS) if s in several and not odd and all(r[f"steady{i}"] for r in files)]
        if len(several) != 1:
            raise ContractError(f"{path}: its header holds {' and '.join(SEPARATORS.values())}, and its lines do not tell which of "
                                "them separates columns; name the delimiter")
    return several[0] if several else ","


def refuse_wide_records(spark: SparkSession, path: str, columns: Sequence[str], options: dict[str, object], separator: str) -> None:
    """The same refusal for a file whose quoted cells span lines, where only the reader itself knows its records."""
    broken = "_broken"
    ddl = ", ".join(f"c{i} string" for i in range(len(columns)))
    read = (spark.read.schema(f"{ddl}, {broken} string").option("columnNameOfCorruptRecord", broken).option("columnPruning", False)
            .options(**options).csv(path))
    found = (read.where(F.col(broken).isNotNull() & (fields(F.col(broken), separator) > len(columns)))
             .select(broken, "c0").limit(1).collect())
    if found:
        start = found[0][0].strip().replace("\n", " ")[:60]
        raise ContractError(f"{path.rsplit('/', 1)[-1]}: the record that begins {start!r} has more than {len(columns)} cells")


def refuse_broken_json(spark: SparkSession, paths: Sequence[str]) -> None:
    """Refuse, by file and line, text that is not one JSON object a line; blank lines are no lines."""
    lines = numbered_lines(spark, paths)
    broken = (F.trim("value") != "") & F.from_json("value", "map<string,string>").isNull()
    found = lines.where(broken).groupBy("_path_no", "_file").agg(F.min("_place").alias("first")).orderBy("_path_no", "_file").first()
    if found:
        line = line_number(lines, found["_path_no"], found["_file"], found["first"])
        raise ContractError(f"{found['_file'].rsplit('/', 1)[-1]}: line {line} is not a JSON object")
