"""Checked CSV -> Parquet ingest of order lines (IO-1 ... IO-10).

* Read: header names first, then every column as a string plus a corrupt
  record column, Latin-1, RFC 4180 quoting (``""`` inside quotes), optional
  embedded newlines. ``multi_line=True``, the default of the batch and the
  streaming ingest, makes each file one task (a quoted newline can sit
  anywhere), so ingest many files in parallel or pass ``multi_line=False``
  when the data has no embedded newlines.
* Every file must have the same header in the same order: Spark matches columns
  by position, so a file with another header fails the read with its name.
* Names: stripped, and ``' '``, ``'-'``, ``'/'`` become ``'_'``; empty headers
  and two headers that collapse to one name are an error.
* Values: stripped of Unicode white space, empty -> NULL, then typed by the
  sanitised name. A value that does not parse becomes NULL in the typed
  column and one row in the reject frame (column, raw value, reason, record).
* Rows with too few fields go to the reject frame only; rows with too many
  fields are kept (extra fields ignored) and noted as a warning.

Everything is column expressions over the scan and one ``explode`` for the
reject rows: no shuffle, no driver loop over data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.schema import ORDER_LINE_SCHEMA, SHIPPING_COST
from salescope.sources.versions import refresh

# Fixed value: the date pattern.
DATE_PATTERN = "d-M-yyyy"

CORRUPT = "_bad"
_RECORD_OPTIONS = {
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_TYPES = {f.name.lower(): f.dataType for f in [*ORDER_LINE_SCHEMA.fields, SHIPPING_COST]}
_SEPARATORS = str.maketrans(dict.fromkeys(" -/", "_"))
# Unicode white space, plus the ASCII separators that Python's strip removes.
_EDGE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def sanitize_name(raw: str) -> str:
    return raw.strip().translate(_SEPARATORS)


def sanitized_names(raw_names: list[str]) -> list[str]:
    by_name: dict[str, str] = {}
    for raw in raw_names:
        name = sanitize_name(raw)
        if not name:
            raise ValueError("a header is empty")
        if name in by_name:
            raise ValueError(f"headers {by_name[name]!r} and {raw!r} both become column {name!r}")
        by_name[name] = raw
    return list(by_name)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """IO-2 on a DataFrame: rename every column to its sanitised name."""
    return df.toDF(*sanitized_names(df.columns))


def target_type(raw_name: str) -> T.DataType:
    return _TYPES.get(sanitize_name(raw_name).lower(), T.StringType())


def csv_options(encoding: str, multi_line: bool) -> dict:
    """Reader options. Every file's header is held against the schema, and every
    column is parsed whatever a query selects: with pruning, Spark would not
    notice missing fields."""
    return {
        "header": "true",
        "enforceSchema": "false",
        "columnPruning": "false",
        "encoding": encoding,
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }


def read_header(spark: SparkSession, path: str, multi_line: bool = True, encoding: str = "ISO-8859-1") -> list[str]:
    """The raw header names, read as data: as a header, Spark would rename duplicates."""
    options = csv_options(encoding, multi_line) | {"header": "false"}
    first = spark.read.options(**options).csv(path).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    header = [name or "" for name in first]
    sanitized_names(header)
    return header


def raw_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in [*header, CORRUPT]])


def read_order_csv(
    spark: SparkSession, path: str, multi_line: bool = True, encoding: str = "ISO-8859-1"
) -> DataFrame:
    """IO-1: raw CSV with every header column as STRING plus ``_bad``.

    A file whose header differs from the first one's makes the read fail.
    """
    header = read_header(spark, path, multi_line, encoding)
    return (
        spark.read.options(**csv_options(encoding, multi_line))
        .schema(raw_schema(header))
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("_source_file"))
    )


def clean_text(c: Column) -> Column:
    """IO-4: strip white space (including no-break space); empty -> NULL."""
    stripped = F.btrim(c, F.lit(_EDGE_SPACE))
    return F.when(stripped != "", stripped)


def _typed(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.try_to_date(text, DATE_PATTERN)
    if isinstance(dtype, T.StringType):
        return text
    return text.try_cast(dtype)


def _field_count(record: Column) -> Column:
    """Fields in a raw CSV record: commas outside quoted sections, plus one. A
    doubled quote ends one section and begins the next."""
    unquoted = F.regexp_replace(record, r'"[^"]*"', "")
    unquoted = F.regexp_replace(unquoted, r"[\r\n]+$", "")
    return F.size(F.split(unquoted, ",", -1))


def _decimals(text: Column) -> Column:
    """Decimal places that a number written as ``text`` needs; NULL for zero."""
    mantissa = F.regexp_replace(text, "[eE].*$", "")
    exponent = F.coalesce(F.regexp_extract(text, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    fraction = F.length(F.regexp_replace(mantissa, r"^[^.]*\.?", ""))
    digits = F.regexp_replace(mantissa, "[^0-9]", "")
    significant = F.rtrim(digits, F.lit("0"))
    return F.when(significant != "", fraction - (F.length(digits) - F.length(significant)) - exponent)


def _field(raw_name: str) -> Column:
    return F.col("`" + raw_name.replace("`", "``") + "`")


def _issue(column: str | Column, value: Column, severity: str, reason: str) -> Column:
    return F.struct(
        (column if isinstance(column, Column) else F.lit(column)).alias("column"),
        value.alias("value"),
        F.lit(severity).alias("severity"),
        F.lit(reason).alias("reason"),
    )


def type_order_lines(raw: DataFrame) -> DataFrame:
    """IO-2 ... IO-7: sanitised names, typed values and an ``_issues`` array.

    The result has the typed columns, ``_issues`` (array of structs: column,
    value, severity, reason), ``_drop`` (row rejected as a whole), ``_record``
    (where there are issues: the record as read if it is malformed, else its raw
    fields as CSV) and the source file.
    """
    raw_names = [c for c in raw.columns if c not in (CORRUPT, "_source_file")]
    names = sanitized_names(raw_names)
    n_fields = len(raw_names)
    typed_cols, checks = [], []
    for raw_name, name in zip(raw_names, names):
        text = clean_text(_field(raw_name))
        dtype = target_type(raw_name)
        value = _typed(text, dtype)
        typed_cols.append(value.alias(name))
        if not isinstance(dtype, T.StringType):
            checks.append(
                F.when(text.isNotNull() & value.isNull(), _issue(name, text, "error", f"not a valid {dtype.simpleString()}"))
            )
        if isinstance(dtype, T.DecimalType):
            checks.append(
                F.when(
                    value.isNotNull() & (_decimals(text) > dtype.scale),
                    _issue(name, text, "warning", f"rounded to {dtype.scale} decimals"),
                )
            )
    record = F.col(CORRUPT)
    fields = _field_count(record)
    short = record.isNotNull() & (fields < n_fields)
    long_ = record.isNotNull() & (fields > n_fields)
    other = record.isNotNull() & (fields == n_fields)
    checks += [
        F.when(short, _issue(F.lit(None).cast("string"), record, "error", "too few fields")),
        F.when(long_, _issue(F.lit(None).cast("string"), record, "warning", "too many fields")),
        F.when(other, _issue(F.lit(None).cast("string"), record, "error", "malformed record")),
    ]
    issues = F.filter(F.array(*checks), lambda x: x.isNotNull())
    as_read = F.to_csv(F.struct(*(_field(c) for c in raw_names)), _RECORD_OPTIONS)
    return raw.select(
        *typed_cols,
        issues.alias("_issues"),
        F.when(F.size(issues) > 0, F.coalesce(record, as_read)).alias("_record"),
        (short | other).alias("_drop"),
        F.col("_source_file"),
    )


def split_good_and_rejects(typed: DataFrame, row_key: str = "Row_ID") -> tuple[DataFrame, DataFrame]:
    """Lines (whole rows kept) and one reject row per problem found, each with
    the record it is in."""
    lines = typed.where(~F.col("_drop")).drop("_issues", "_drop", "_record", "_source_file")
    key = F.col(row_key).cast("string") if row_key in typed.columns else F.lit(None).cast("string")
    rejects = typed.where(F.size("_issues") > 0).select(
        F.col("_source_file").alias("source_file"),
        key.alias("row_key"),
        F.explode("_issues").alias("issue"),
        F.col("_record").alias("record"),
    ).select("source_file", "row_key", "issue.*", "record")
    return lines, rejects


def with_order_year(lines: DataFrame) -> DataFrame:
    return lines.withColumn("order_year", F.year("Order_Date"))


def write_order_lines(lines: DataFrame, path: str) -> None:
    """IO-8: a plain Parquet table, partitioned by order year so that date-filtered
    analyses prune whole directories; what ``path`` held is overwritten. A store that
    is read meanwhile is refreshed by ``store.refresh_order_store``.

    Rows are rebalanced by year first: adaptive execution splits a large year and
    joins small ones, so that files have about the advisory partition size
    instead of each task writing one for each year it meets.
    """
    with_order_year(lines).hint("rebalance", "order_year").write.mode("overwrite").partitionBy("order_year").parquet(path)


def load_report(lines: DataFrame) -> DataFrame:
    """IO-9: one row per column (position, name, type) with the table's row
    and column counts. The column list is schema metadata, not data."""
    spark = lines.sparkSession
    meta = spark.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(lines.schema.fields)],
        "position int, column string, type string",
    )
    counts = lines.agg(F.count(F.lit(1)).alias("table_rows")).withColumn(
        "table_columns", F.lit(len(lines.columns)).cast("bigint")
    )
    return meta.crossJoin(F.broadcast(counts)).orderBy("position")


def sample_rows(lines: DataFrame, n: int = 3) -> DataFrame:
    """IO-10: a few rows for a first look."""
    return lines.limit(n)


@dataclass
class IngestResult:
    lines: DataFrame
    rejects: DataFrame


def ingest_order_csv(
    spark: SparkSession,
    csv_path: str,
    out_path: str | None = None,
    reject_path: str | None = None,
    multi_line: bool = True,
    encoding: str = "ISO-8859-1",
    staged: bool = False,
) -> IngestResult:
    """Read, check and type order lines; optionally write lines and rejects.

    Nothing is cached: lines and rejects are two passes over the CSV, each
    of which a lost executor repeats for its own files only. ``staged`` makes the lines
    a new version of the store at ``out_path``, which readers see once it is complete;
    without it a plain table is overwritten.
    """
    typed = type_order_lines(read_order_csv(spark, csv_path, multi_line, encoding))
    lines, rejects = split_good_and_rejects(typed)
    if out_path is not None:
        folder = out_path
        if staged:
            checked = lines
            folder = refresh(spark, out_path, lambda new: write_order_lines(checked, new))
        else:
            write_order_lines(lines, out_path)
        lines = spark.read.parquet(folder).drop("order_year")
    if reject_path is not None:
        rejects.write.mode("overwrite").parquet(reject_path)
        rejects = spark.read.parquet(reject_path)
    return IngestResult(lines, rejects)
