"""Sources: fact-table scans (S1, S2), the temp view (S4) and the multi-file
series scan (S9)."""

from __future__ import annotations

import csv
import re
from typing import Mapping, Optional, Sequence, Union
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.exprs import q


def read_table(spark: SparkSession, path: Union[str, Sequence[str]], fmt: str = "parquet",
               options: Optional[Mapping[str, object]] = None,
               schema: Optional[Union[StructType, str]] = None) -> DataFrame:
    """Read a fact table in any Spark format with reader options.
    Parquet is the default: filters and column pruning reach the scan.
    For CSV, a declared ``schema`` avoids the extra inference pass."""
    reader = spark.read.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path if isinstance(path, str) else list(path))


def read_csv(spark: SparkSession, path: Union[str, Sequence[str]], header: bool = True,
             delimiter: str = ",", schema: Optional[Union[StructType, str]] = None) -> DataFrame:
    """S1 as the reference does it: header row, inferred types unless a
    schema is given."""
    opts = {"header": header, "delimiter": delimiter}
    if schema is None:
        opts["inferSchema"] = True
    return read_table(spark, path, "csv", opts, schema)


def register_view(df: DataFrame, name: str = "service_data") -> DataFrame:
    """Expose the fact table to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df


def file_headers(spark: SparkSession, paths: Sequence[str], delimiter: str = ",") -> dict[tuple[str, ...], list[str]]:
    """The files under ``paths`` by their header (first line), in file order.
    One scan keeps one line per file; the driver holds the file names only, as it
    does for any scan.  Empty files have none."""
    first = F.min_by(F.struct("value"), "_at")  # ids rise along a file's first split
    rows = spark.read.option("recursiveFileLookup", "true").text(list(paths)) \
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("_at")) \
        .where("start = 0").groupBy("path").agg(first["value"].alias("line")).orderBy("path").collect()
    found: dict[tuple[str, ...], list[str]] = {}
    for r in rows:
        names = next(csv.reader([r["line"].removeprefix("\ufeff").rstrip("\r")], delimiter=delimiter), [])
        found.setdefault(tuple(names), []).append(unquote(r["path"]))
    return found


def _literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _decoded(text: Column) -> Column:
    """A percent-encoded text, its plus signs kept."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _folder_value(key: str) -> Column:
    """The text value of a ``key=value`` folder of the row's file, NULL for Spark's
    name of a NULL value."""
    raw = F.regexp_extract(_decoded(F.col("_metadata.file_path")), f"/{re.escape(key)}=([^/]*)/", 1)
    return F.when(raw != "__HIVE_DEFAULT_PARTITION__", _decoded(raw))


def _common_types(frames: Sequence[DataFrame]) -> dict[str, str]:
    """A type per column that holds what every frame has: the widest number, else text."""
    number = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    kinds: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            had = kinds.setdefault(name, kind)
            if had != kind:
                both = had in number and kind in number
                kinds[name] = number[max(number.index(had), number.index(kind))] if both else "string"
    return kinds


def read_series_files(spark: SparkSession, paths: Union[str, Sequence[str]],
                      schema: Optional[Union[StructType, str]] = None, header: bool = True, delimiter: str = ",") -> DataFrame:
    """S9 + U3: many series CSV files read as one DataFrame with a ``series``
    column naming the file each row came from (file name without ``.csv``), or
    the ``series=`` folder that ``sinks.write_series`` wrote it to; other
    ``key=value`` folders become text columns.

    Every file is read by its own header: files with the same header are one
    scan, and the scans are united by column name, whatever the order of the
    columns; a column that a file lacks is NULL in its rows.  With a ``schema``
    the result has its columns and types (a header's other columns are left
    out), without one the union of the headers' columns with inferred types
    (text where the files disagree).  ``header=False`` reads by position."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    want = None if schema is None else (schema if isinstance(schema, StructType) else StructType.fromDDL(schema))
    name = F.regexp_extract(_decoded(F.col("_metadata.file_name")), r"^(.*?)(\.csv)?$", 1)
    base = spark.read.option("delimiter", delimiter)
    if not header:
        reader = base.schema(want) if want is not None else base.option("inferSchema", "true")
        return reader.csv(paths).withColumn("series", name)
    groups = file_headers(spark, paths, delimiter)
    if not groups:
        if want is None:
            raise ValueError("no file has a header")
        return spark.createDataFrame([], want).withColumn("series", F.lit(None).cast("string"))
    given = "".join(f"/{p}/" for p in paths)
    folders = list(dict.fromkeys(k for files in groups.values() for f in files for k in re.findall(r"/([^/=]+)=[^/]*(?=/)", f)
                                 if f"/{k}=" not in given))
    kinds = {} if want is None else {f.name: f.dataType for f in want.fields}
    frames = []
    for names, files in groups.items():
        reader = base.option("header", "true")
        reader = reader.option("inferSchema", "true") if want is None else reader.schema(
            StructType([StructField(n, kinds.get(n, StringType())) for n in names]))
        df = reader.csv([_literal(f) for f in files])
        kept = [c for c in df.columns if want is None or c in kinds]
        extra = {k: _folder_value(k) for k in folders if k not in kept}
        if "series" not in kept and "series" not in extra:
            extra["series"] = name
        frames.append(df.select(*[F.col(q(c)) for c in kept], *[v.alias(k) for k, v in extra.items()]))
    if want is None:
        types = _common_types(frames)
        frames = [df.select(*[F.col(q(c)).cast(types[c]).alias(c) for c in df.columns]) for df in frames]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if want is None:
        return out
    rest = [c for c in out.columns if c not in kinds]
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields if f.name not in out.columns]
    return out.select("*", *missing).select(*[F.col(q(f.name)) for f in want.fields], *[F.col(q(c)) for c in rest])
