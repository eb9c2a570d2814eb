"""Scans and sinks (section A of the inventory)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import strip_text, to_double


class MissingColumnsError(ValueError):
    """Raised by ``require_columns``; carries the missing and present names."""

    def __init__(self, missing, present):
        self.missing = list(missing)
        self.present = list(present)
        super().__init__(f"missing columns {self.missing}; present {self.present}")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str | None = None, header: bool = True) -> DataFrame:
    """A1: a table with a header row under an explicit schema.

    Parquet is the stored form; CSV is read with the given schema (no
    inference pass). A parsed NaN becomes NULL. A directory of part files is one table (A11).
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", header).option("mode", "PERMISSIVE").csv(path)
    else:
        df = reader.format(fmt).load(path)
    floats = [c for c, kind in df.dtypes if kind in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_parts(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None) -> DataFrame:
    """All part files of a directory as one table."""
    return read_table(spark, path, schema=schema, fmt=fmt)


def read_pairs(spark: SparkSession, path: str, names=("smiles", "target"),
               encoding: str = "UTF-8") -> DataFrame:
    """A2: two-column file; line 1 skipped, names imposed, target coerced."""
    schema = ", ".join(f"`{n}` string" for n in names)
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
          .option("encoding", encoding).csv(path))
    return df.withColumn(names[1], to_double(names[1]))


# The charsets tried in order by the text readers. UTF-8 comes
# first because UTF-8 bytes can decode as GBK without error; ISO-8859-1 decodes
# anything, so nothing can follow it.
DEFAULT_ENCODINGS = ("UTF-8", "GBK", "GB18030", "ISO-8859-1")


def detect_encoding(spark: SparkSession, path: str, encodings=DEFAULT_ENCODINGS) -> str:
    """A3: the first charset that decodes every line of the file.

    The file is read once, as raw bytes: every task tries all charsets on its
    lines, and one aggregate tells which ones none refused. Raises if none fits.
    """
    names = list(encodings)

    def run(batches):
        fits = [True] * len(names)
        for b in batches:
            raw = b"\n".join(x or b"" for x in b.column(0).to_pylist())
            for i, name in enumerate(names):
                if fits[i]:
                    try:
                        raw.decode(name)
                    except UnicodeDecodeError:
                        fits[i] = False
        yield pa.RecordBatch.from_arrays([pa.array([fits], pa.list_(pa.bool_()))], names=["fits"])

    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("value"))
    all_fit = lines.mapInArrow(run, "fits array<boolean>").agg(*[F.bool_and(F.get("fits", F.lit(i))).alias(f"c{i}") for i in range(len(names))]).first()
    for name, fit in zip(names, all_fit):
        if fit is not False:
            return name
    raise ValueError(f"no charset of {names} decodes {path}")


def raw_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """Lines as they are, in one column ``line``; with ``header`` the first line of each file goes.

    The CSV reader with a separator that no text holds, and without quoting,
    decodes any charset and knows the first line of each file.
    """
    return (spark.read.schema("line string").option("header", header).option("enforceSchema", True).option("sep", "\u0001").option("quote", "")
            .option("escape", "").option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))


def read_text_table(spark: SparkSession, path: str, schema: StructType | str,
                    encodings=DEFAULT_ENCODINGS, header: bool = True) -> DataFrame:
    """A3: CSV read under the first charset that decodes the whole file."""
    enc = detect_encoding(spark, path, encodings)
    return (spark.read.schema(schema).option("header", header).option("encoding", enc)
            .csv(path))


def read_lines(spark: SparkSession, path: str, min_fields: int = 3,
               header: bool = True) -> DataFrame:
    """Raw lines kept as they are; lines with fewer comma fields dropped.

    Returns ``(line, smiles)`` where ``smiles`` is the stripped first field. The
    header is the first line of each file; a data line equal to it stays.
    """
    return lines_with_fields(raw_lines(spark, path, header=header), "line", min_fields)


def lines_with_fields(df: DataFrame, line_col: str = "line", min_fields: int = 3) -> DataFrame:
    """A6 on an existing column of lines."""
    fields = F.split(strip_text(line_col), ",")
    return df.where(F.size(fields) >= min_fields).withColumn("smiles", strip_text(fields.getItem(0)))


def require_columns(df: DataFrame, cols) -> DataFrame:
    """A5: fail before any work when a column is missing (no data scan)."""
    present = df.columns
    missing = [c for c in cols if c not in present]
    if missing:
        raise MissingColumnsError(missing, present)
    return df


def pick_column(df: DataFrame, *names: str) -> str:
    """The first of several alternative names present in ``df``."""
    for n in names:
        if n in df.columns:
            return n
    raise MissingColumnsError(names, df.columns)


def conform(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B1: rename to the canonical schema; absent source names are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def union_all(frames) -> DataFrame:
    """H1/H5: union by name of several frames; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                header: bool = True, partition_by=None, signature: bool = False) -> str:
    """Distributed write; an empty result still carries its schema.

    ``fmt='csv'`` writes a header per part file; no single-file coalesce. With
    ``signature`` each of these headers begins with the UTF-8 byte order mark
    (utf-8-sig); it needs a header. ``mode='append'`` adds part files.
    """
    if signature:
        if fmt != "csv" or not header:
            raise ValueError("a signature needs CSV with a header")
        df = df.toDF(f"\ufeff{df.columns[0]}", *df.columns[1:])
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_side_outputs(outputs: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict:
    """Several named outputs (rejects, stats, weights, splits) of one plan."""
    return {name: write_table(df, f"{base.rstrip('/')}/{name}", fmt=fmt)
            for name, df in outputs.items()}
