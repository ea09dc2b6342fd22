"""Reading files as tables under a declared schema, with each row's position and origin.

Every table carries `_ord` (position across all files in the order given), `_src_file` and
`_src_row` (position within the file). Parquet knows its row positions, so nothing is
shuffled for them. Text formats do not: their rows are landed once as text columns in
parquet beside the split they came from, and positions are the running row counts of the
splits.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError
from rowproof.functions.predicate import name
from rowproof.ordinals import ORD, running_offsets
from rowproof.schema import DATES, SCALARS, Table, promoted
from rowproof.session import land, look_up
from rowproof.sources.survey import TextFile, refuse_broken_json, refuse_wide_records, survey_separated

# File name endings and the format each one names.
FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".parquet": "parquet",
    ".json": "json", ".jsonl": "json", ".geojson": "geojson",
}

# Cell texts that read as an absent value.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Spellings of a day once its separators are single spaces, each guarded by its shape.
DAY_SHAPES = (
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4} \d{1,2} \d{1,2}$", "yyyy M d"),
    (r"^(?:0?[1-9]|1[0-2]) \d{1,2} \d{4}$", "M d yyyy"),
    (r"^(?:1[3-9]|2\d|3[01]) \d{1,2} \d{4}$", "d M yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"),
)


def format_of(path: str) -> str:
    lowered = path.rstrip("/").lower()
    for ending, label in FORMATS.items():
        if lowered.endswith(ending):
            return label
    raise ContractError(f"{path}: the file name does not say one of {sorted(set(FORMATS.values()))}")


def read_source(spark: SparkSession, paths: str | Sequence[str], format: str | None = None,
                schema: Table | None = None, *, list_columns: Sequence[str] = (),
                parse_dates: Sequence[str] = (), dtype: Mapping[str, str] | None = None,
                delimiter: str | None = None, ordinals: bool = True, infer: bool = False) -> DataFrame:
    """One table from one or more files of one format, in the order given.

    `ordinals=False` skips positions (and the landing of text formats) for a use that needs none.
    Text columns that nothing declares stay text; `infer=True` reads the whole of them and makes those
    whose every cell is an integer, a number or a truth value what they are.
    A text file is gone through once before it is read: a line with more cells than its header, or that is not a
    JSON object, is refused by file and number, as are files whose types of one column do not go together.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ContractError("no file is bound")
    label = format or format_of(paths[0])
    if format is None and {format_of(p) for p in paths} != {label}:
        raise ContractError("files of one table share a format")
    if label not in set(FORMATS.values()):
        raise ContractError(f"{label!r} is not a format read here")
    for path in paths:
        try:
            spark.read.text(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                raise ContractError(f"bound file does not exist: {path}") from error
            raise
    if label in ("csv", "tsv"):
        known = survey_separated(spark, paths, ["\t" if label == "tsv" else delimiter] * len(paths))
        reads = [_read_separated(spark, path, file) for path, file in zip(paths, known)]
    elif label == "json":
        refuse_broken_json(spark, paths)
        reads = [_read_json_lines(spark, path, schema) for path in paths]
    else:
        reads = [_read_geojson(spark, path) if label == "geojson" else spark.read.parquet(path) for path in paths]
    _same_columns(paths, reads)
    whole = _with_origin(_one_type_each(reads), label, ordinals)
    return _typed(whole, label, schema, list_columns, parse_dates, dtype or {}, infer)


def read_parquet(spark: SparkSession, path: str, ordinals: bool = True) -> DataFrame:
    return read_source(spark, path, "parquet", ordinals=ordinals)


def _same_columns(paths: Sequence[str], reads: Sequence[DataFrame]) -> None:
    first = set(reads[0].columns) - {"_metadata"}
    for path, read in zip(paths[1:], reads[1:]):
        here = set(read.columns) - {"_metadata"}
        if here != first:
            raise ContractError(
                f"{path.rsplit('/', 1)[-1]} does not carry the columns of "
                f"{paths[0].rsplit('/', 1)[-1]}: it lacks {sorted(first - here)} "
                f"and adds {sorted(here - first)}")


def _one_type_each(reads: Sequence[DataFrame]) -> list[DataFrame]:
    """The files' columns as the types they promote to; types that do not go together are refused from the schemas alone."""
    columns = [c for c in reads[0].columns if c != "_metadata"]
    target = {c: promoted([r.schema[c].dataType for r in reads], c) for c in columns}
    out = []
    for read in reads:
        odd = {c: name(c).cast(t) for c, t in target.items() if read.schema[c].dataType != t}
        out.append(read.select(*[odd[c].alias(c) if c in odd else name(c) for c in columns], "_metadata") if odd else read)
    return out


# ── one file ───────────────────────────────────────────────────────────────


def _read_separated(spark: SparkSession, path: str, file: TextFile) -> DataFrame:
    options = {"header": True, "sep": file.separator, "escape": '"', "multiLine": file.multi_line,
               "encoding": "iso-8859-1" if file.western else "UTF-8"}
    read = spark.read.options(**options).csv(path)
    if file.multi_line:
        refuse_wide_records(spark, path, read.columns, options, file.separator)
    return _from_windows_1252(read, path) if file.western else read


# Spark decodes ISO-8859-1 but not windows-1252; the two differ in bytes 0x80 to 0x9F alone, which
# are put right afterwards. Five of those bytes stand for no character.
_C1 = [bytes([b]) for b in range(0x80, 0xA0)]
_SHIFTED = {b.decode("latin-1"): b.decode("cp1252", "ignore") for b in _C1}
_UNDEFINED = "".join(raw for raw, real in _SHIFTED.items() if not real)


def _from_windows_1252(read: DataFrame, path: str) -> DataFrame:
    raw = "".join(k for k, v in _SHIFTED.items() if v)
    real = "".join(v for v in _SHIFTED.values() if v)
    broken = F.lit(False)
    for c in read.columns:
        broken = broken | F.coalesce(name(c).rlike(f"[{_UNDEFINED}]"), F.lit(False))
    if not read.where(broken).isEmpty():
        raise ContractError(f"{path} is neither UTF-8 nor windows-1252")
    return read.select("_metadata", *[
        F.translate(name(c), raw, real).alias(c.translate(str.maketrans(raw, real))) for c in read.columns])


def _read_json_lines(spark: SparkSession, path: str, schema: Table | None) -> DataFrame:
    reader = spark.read.option("primitivesAsString", True)
    held = reader.json(path).schema
    shaped = []
    for f in held.fields:
        declared = schema.get(f.name) if schema else None
        nested = declared is not None and declared.type not in SCALARS
        shaped.append(T.StructField(f.name, declared.spark_type if nested else f.dataType))
    return spark.read.schema(T.StructType(shaped)).json(path)


def _read_geojson(spark: SparkSession, path: str) -> DataFrame:
    held = spark.read.option("multiLine", True).json(path).schema
    if "features" not in held.names or not isinstance(held["features"].dataType, T.ArrayType):
        raise ContractError(f"{path} is not a feature collection")
    feature = held["features"].dataType.elementType
    properties = T.StructType([])
    if isinstance(feature, T.StructType) and "properties" in feature.names and isinstance(
            feature["properties"].dataType, T.StructType):
        properties = feature["properties"].dataType
    # Coordinates differ in depth by geometry type, so they are read as JSON text. So are properties: whether a
    # feature has a key is asked of the feature, not of the schema that all of them share.
    shape = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StringType()),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ])))])
    features = (spark.read.option("multiLine", True).schema(shape).json(path)
                .select("_metadata", F.explode("features").alias("f")))
    # `try_element_at` gives null where a point carries fewer than two coordinates.
    numbers = F.from_json(F.col("f.geometry.coordinates"), "array<double>")
    point = F.when(F.col("f.geometry.type") == "Point", numbers)
    features = features.withColumn("_p", F.from_json("f.properties", properties) if properties.names else F.lit(None))
    cells = [F.col("_p")[p].alias(p) for p in properties.names if p not in ("lon", "lat")]
    keys = F.coalesce(F.json_object_keys("f.properties"), F.array().cast("array<string>"))
    for at, axis in ((1, "lon"), (2, "lat")):
        given = F.try_element_at(point, F.lit(at))
        if axis in properties.names:
            kind = properties[axis].dataType
            kind = T.DoubleType() if isinstance(kind, T.NumericType) else kind
            given = given if kind == T.DoubleType() else given.cast("string") if isinstance(kind, T.StringType) else F.lit(None)
            given = F.when(F.array_contains(keys, axis), F.col("_p")[axis].cast(kind)).otherwise(given.cast(kind))
        cells.append(given.alias(axis))
    return features.select(*cells, "_metadata")


# ── positions ──────────────────────────────────────────────────────────────


def _with_origin(reads: Sequence[DataFrame], label: str, ordinals: bool) -> DataFrame:
    columns = [c for c in reads[0].columns if c != "_metadata"]
    if not ordinals:
        # Nothing of the file metadata is touched, so scans stay as narrow as the query.
        plain = reads[0].select(*[name(c) for c in columns])
        for read in reads[1:]:
            plain = plain.unionByName(read.select(*[name(c) for c in columns]))
        return plain
    if label == "parquet" and len(reads) == 1 and len(reads[0].inputFiles()) <= 1:
        return reads[0].select(
            "*", F.col("_metadata.file_path").alias("_src_file"),
            F.col("_metadata.row_index").alias("_src_row"), F.col("_metadata.row_index").alias(ORD))
    row = "_metadata.row_index" if label == "parquet" else None
    parts = []
    for position, read in enumerate(reads):
        origin = [F.lit(position).alias("_path_no"),
                  F.col("_metadata.file_path").alias("_src_file")]
        if row:
            origin.append(F.col(row).alias("_src_row"))
        else:
            origin += [F.col("_metadata.file_block_start").alias("_split"),
                       F.monotonically_increasing_id().alias("_at")]
        parts.append(read.select(*[name(c) for c in columns], *origin))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if row:
        # Counting rows per file reads footers alone.
        files = whole.groupBy("_path_no", "_src_file").agg(F.count(F.lit(1)).alias("_rows"))
        offsets = running_offsets(files, ["_path_no", "_src_file"], "_rows", "_before")
        numbered = look_up(whole, offsets.drop("_rows"), ["_path_no", "_src_file"])
        return (numbered.withColumn(ORD, F.col("_before") + F.col("_src_row"))
                .drop("_path_no", "_before"))
    landed = land(whole, "text")
    splits = landed.groupBy("_path_no", "_src_file", "_split").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_start"))
    offsets = running_offsets(splits, ["_path_no", "_src_file", "_split"], "_rows", "_before")
    in_file = F.col("_before") - F.min("_before").over(W.partitionBy("_path_no", "_src_file"))
    offsets = offsets.withColumn("_file_before", in_file).drop("_rows")
    numbered = look_up(landed, offsets, ["_path_no", "_src_file", "_split"])
    return (numbered.withColumn("_within", F.col("_at") - F.col("_start"))
            .withColumn(ORD, F.col("_before") + F.col("_within"))
            .withColumn("_src_row", F.col("_file_before") + F.col("_within"))
            .select(*[name(c) for c in columns], "_src_file", "_src_row", ORD))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the files hold too few splits for them, before costly row work.

    Only a table smaller than one split per core is moved, which bounds what the shuffle
    carries; a larger one already has the splits, and is left where it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    held = spark.read.format("binaryFile").load(list(files)).agg(F.sum("length")).first()[0] or 0
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    split = int(text.rstrip("bB")) if text.rstrip("bB").isdigit() else 128 << 20
    return df.repartition(cores) if held < cores * split else df


# ── declared types ─────────────────────────────────────────────────────────


def split_list(column: Column) -> Column:
    """`[a, b]` as a list of its trimmed, non-blank parts; an absent cell as the empty list."""
    inner = F.regexp_replace(F.trim(column), r"(?s)^\[(.*)\]$", "$1")
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def parse_when(column: Column) -> Column:
    """A timestamp from text, or null where no accepted spelling fits.

    Beside ISO: a day in digits (year first; or month, day, year, unless the first cannot be a month), or with the
    month's name before or after the day; separated by spaces, commas, dots, slashes or hyphens; with or without a
    time of hours and minutes, seconds, and am or pm.
    """
    text = F.trim(column)
    plain = F.trim(F.regexp_replace(text, r"[\s,./-]+", " "))
    clock = F.regexp_extract(plain, r" (\d{1,2}:\d{2}(?::\d{2})?(?: ?[AaPp][Mm])?)$", 1)
    day_text = F.trim(F.regexp_replace(plain, r" \d{1,2}:\d{2}(?::\d{2})?(?: ?[AaPp][Mm])?$", ""))
    day = F.coalesce(*[F.when(day_text.rlike(shape), F.try_to_timestamp(day_text, F.lit(pattern)).cast("timestamp_ntz"))
                       for shape, pattern in DAY_SHAPES])
    parts = F.split(F.regexp_replace(clock, r" ?[AaPp][Mm]$", ""), ":")
    hour, minute = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    second = F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("int"), F.lit(0))
    half = F.lower(F.substring(clock, -2, 1))
    hour = F.when(half.isin("a", "p"), F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(hour)
    timed = F.when((hour < 24) & (minute < 60) & (second < 60), day + F.make_dt_interval(F.lit(0), hour, minute, second))
    iso = F.when(~text.rlike(r"^\d{8}$"), text.try_cast("timestamp_ntz"))
    return F.coalesce(iso, F.when(clock == "", day).otherwise(timed))


def typed_cell(column: Column, kind: str) -> Column:
    """Text read as one declared type; null where it does not fit."""
    text = F.trim(column)
    if kind == "int":
        real = text.try_cast("double")
        whole = F.when((real == F.floor(real)) & (F.abs(real) < 9.0e15), real.try_cast("bigint"))
        return F.coalesce(text.try_cast("bigint"), whole)
    if kind == "float":
        real = text.try_cast("double")
        return F.when(~F.isnan(real), real)
    if kind == "bool":
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if kind == "datetime":
        return parse_when(column)
    if kind == "date":
        return parse_when(column).cast("date")
    return column


def _typed(df: DataFrame, label: str, schema: Table | None, list_columns: Sequence[str],
           parse_dates: Sequence[str], dtype: Mapping[str, str], infer: bool) -> DataFrame:
    """Declared types over text cells. The text itself stays in `_raw_<column>`, unread unless asked for."""
    if label in ("parquet", "geojson"):
        dated = [c for c in parse_dates if isinstance(df.schema[c].dataType, T.StringType)]
        return df.withColumns({c: parse_when(name(c)) for c in dated}) if dated else df
    free = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")
            and f.name not in (*dtype, *list_columns, *parse_dates) and (schema is None or schema.get(f.name) is None)]
    dtype = {**inferred(df, free), **dtype} if infer and free else dtype
    cells: list[Column] = []
    for f in df.schema.fields:
        if f.name.startswith("_"):
            cells.append(name(f.name))
            continue
        declared = schema.get(f.name) if schema else None
        if not isinstance(f.dataType, T.StringType):
            cells.append(name(f.name))
            continue
        text = name(f.name)
        if label != "json":
            text = F.when(~text.isin(list(NULL_WORDS)), text)
        if f.name in list_columns:
            cells.append(split_list(text).alias(f.name))
            continue
        kind = dtype.get(f.name) or (declared.type if declared else "str")
        if f.name in parse_dates and kind not in DATES:
            kind = "datetime"
        if kind in ("int", "float", "bool", "datetime", "date"):
            cells += [typed_cell(text, kind).alias(f.name), text.alias(f"_raw_{f.name}")]
        elif declared is not None and declared.type not in SCALARS and not declared.type.startswith("list[list"):
            cells += [F.from_json(text, declared.spark_type).alias(f.name), text.alias(f"_raw_{f.name}")]
        else:
            cells.append(text.alias(f.name))
    return df.select(*cells)


def inferred(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The declared type that all present cells of each text column read as, in one pass over all of them; text if none."""
    figures = []
    for i, c in enumerate(columns):
        text = F.trim(F.when(~name(c).isin(list(NULL_WORDS)), name(c)))
        figures += [F.count(text).alias(f"n{i}"), F.count(F.when(text.rlike(r"^[+-]?\d{1,18}$"), 1)).alias(f"int{i}"),
                    F.count(F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))).alias(f"float{i}"),
                    F.count(F.when(F.lower(text).isin("true", "false"), 1)).alias(f"bool{i}")]
    counts = df.agg(*figures).first()
    return {c: next((k for k in ("bool", "int", "float") if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]), "str")
            for i, c in enumerate(columns)}


def lost_cells(df: DataFrame) -> DataFrame:
    """column, lost: cells of each typed column whose text was there but does not read as its type; one pass."""
    typed = [c for c in df.columns if f"_raw_{c}" in df.columns]
    if not typed:
        return df.sparkSession.createDataFrame([], "column string, lost bigint")
    counts = df.agg(*[F.count_if(name(f"_raw_{c}").isNotNull() & name(c).isNull()).alias(f"n{i}") for i, c in enumerate(typed)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("lost")) for i, c in enumerate(typed)])))
