"""Readers: a dataset's URL, format and inline values to a DataFrame."""

from __future__ import annotations

import json
import re
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import times
from chartloom.functions.compile import Scope, quoted
from chartloom.functions.types import kind_of

#: URLs that name a registered dataset: table://name, or any scheme that ends in +dataset.
INLINE = re.compile(r"(?:table|[\w-]+\+dataset)://(.+)")


def format_of(url: str, given: str | None) -> str:
    """csv, tsv, json, arrow or parquet: the given type first (``json`` only if the name has no other), then the ending."""
    ending = urlparse(url).path.rsplit(".", 1)[-1].lower()
    known = {"csv": "csv", "tsv": "tsv", "json": "json", "arrow": "arrow", "feather": "arrow", "parquet": "parquet"}
    if given and given != "json" and given in known:
        return known[given]
    if ending in known:
        return known[ending]
    if given == "json":
        return "json"
    raise ValueError(f"cannot tell the format of {url!r}")


def read_url(spark: SparkSession, url: str, form: dict | None, scope: Scope, tables: dict, base: str | None = None) -> DataFrame:
    """A URL's rows. Names of registered datasets come first, then files by format, then session tables."""
    url = url.split("#", 1)[0]
    form = form or {}
    if m := INLINE.fullmatch(url):
        if m[1] in tables:
            return tables[m[1]]
        if re.fullmatch(r"[\w.]+", m[1]) and spark.catalog.tableExists(m[1]):
            return spark.table(m[1])
        raise ValueError(f"no dataset is registered as {m[1]!r}")
    try:
        kind = format_of(url, form.get("type"))
    except ValueError:
        if re.fullmatch(r"[\w.]+", url) and spark.catalog.tableExists(url):
            return spark.table(url)
        raise
    if base and "://" not in url and not url.startswith("/"):
        url = f"{base.rstrip('/')}/{url}"
    parse = form.get("parse") if isinstance(form.get("parse"), dict) else {}
    if kind in ("csv", "tsv"):
        df = read_csv(spark, url, form.get("delimiter") or ("\t" if kind == "tsv" else ","), parse)
    elif kind == "json":
        df = spark.read.option("multiLine", True).option("primitivesAsString", False).json(url)
        df = _in_file_order(spark, df, url)
    elif kind == "arrow":
        df = read_arrow(spark, url)
    else:
        df = spark.read.parquet(url)
    return dated(df, parse, scope)


def _in_file_order(spark: SparkSession, df: DataFrame, url: str) -> DataFrame:
    """Columns in the order of the first object's keys; Spark sorts inferred names."""
    head = spark.read.option("wholetext", True).text(url).select(F.substring("value", 1, 100_000).alias("v")).first()
    try:
        first = json.JSONDecoder().raw_decode(head["v"].lstrip().lstrip("[").lstrip())[0]
    except (ValueError, TypeError):
        return df
    known = [c for c in first if c in df.columns] if isinstance(first, dict) else []
    return df.select(*[quoted(c) for c in known + [c for c in df.columns if c not in known]])


def read_csv(spark: SparkSession, url: str, separator: str, parse: dict) -> DataFrame:
    """Names from the header; numbers and booleans where ``parse`` says so, strings elsewhere."""
    read = spark.read.option("header", True).option("sep", separator).option("multiLine", False)
    columns = read.csv(url).columns  # reads the header only
    kinds = {"number": T.DoubleType(), "boolean": T.BooleanType()}
    schema = T.StructType([T.StructField(c, kinds.get(parse.get(c), T.StringType())) for c in columns])
    return read.schema(schema).csv(url)


def read_arrow(spark: SparkSession, url: str) -> DataFrame:
    """An Arrow or Feather file, its bytes read by Spark so that any store will do; one file is one task."""
    blob = spark.read.format("binaryFile").load(url).select("content")
    first = pa.ipc.open_file(pa.BufferReader(blob.first()["content"])).schema
    schema = spark.createDataFrame(pa.Table.from_batches([], first)).schema

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from pa.ipc.open_file(pa.BufferReader(content.as_py())).read_all().to_batches()

    return blob.mapInArrow(rows, schema)


def dated(df: DataFrame, parse: dict, scope: Scope) -> DataFrame:
    """Columns that ``parse`` makes dates, and naive times brought to the input zone.

    ``date`` reads in the input zone, ``utc`` in UTC, either with a d3 format after a
    colon. Whole numbers are years.
    """
    zone = scope.input_zone or scope.zone
    new = {}
    for field in df.schema.fields:
        spec = parse.get(field.name)
        c = quoted(field.name)
        if isinstance(spec, str) and spec.split(":")[0] in ("date", "utc"):
            where = "UTC" if spec.startswith("utc") else zone
            fmt = spec.split(":", 1)[1].strip().strip("'\"") if ":" in spec else None
            if isinstance(field.dataType, T.IntegralType) or fmt == "%Y":
                naive = F.try_make_timestamp_ntz(c.try_cast("int"), *[F.lit(x) for x in (1, 1, 0, 0, 0)])
                new[field.name] = times.localized(naive, where if fmt else "UTC", scope.session)
            elif kind_of(field.dataType) == "time":
                new[field.name] = c.cast("timestamp")
            elif fmt and (java := times.java_pattern(fmt)):
                new[field.name] = times.localized(times._try_ntz(c.cast("string"), java), where, scope.session)
            else:
                new[field.name] = times.parsed(c.cast("string"), where, scope.session)
        elif spec == "number" and not isinstance(field.dataType, T.NumericType):
            new[field.name] = c.try_cast("double")
        elif spec == "boolean" and not isinstance(field.dataType, T.BooleanType):
            new[field.name] = c.try_cast("boolean")
        elif spec == "string" and not isinstance(field.dataType, T.StringType):
            new[field.name] = c.cast("string")
        elif isinstance(field.dataType, T.TimestampNTZType):
            new[field.name] = times.localized(c, zone, scope.session)
    return df.withColumns(new) if new else df


def _common(values: list) -> T.DataType:
    some = [v for v in values if v is not None]
    if not some:
        return T.StringType()
    if all(isinstance(v, bool) for v in some):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in some):
        return T.LongType()
    if all(isinstance(v, int | float) and not isinstance(v, bool) for v in some):
        return T.DoubleType()
    if all(isinstance(v, dict) for v in some):
        names = list(dict.fromkeys(k for v in some for k in v))
        return T.StructType([T.StructField(n, _common([v.get(n) for v in some])) for n in names])
    if all(isinstance(v, list) for v in some):
        return T.ArrayType(_common([x for v in some for x in v]))
    return T.StringType()


def _fit(value, dtype: T.DataType):
    if value is None:
        return None
    match dtype:
        case T.StructType():
            return tuple(_fit(value.get(f.name), f.dataType) for f in dtype.fields)
        case T.ArrayType():
            return [_fit(v, dtype.elementType) for v in value]
        case T.DoubleType():
            return float(value)
        case T.StringType():
            return value if isinstance(value, str) else json.dumps(value) if not isinstance(value, bool) else str(value).lower()
    return value


def from_values(spark: SparkSession, values: list) -> DataFrame:
    """Inline values: objects are rows; plain values fill the column ``data``; empty objects a ``datum``."""
    if not values:
        return spark.createDataFrame([], T.StructType([T.StructField("_empty", T.DoubleType())]))
    if not all(isinstance(v, dict) for v in values):
        values = [{"data": v} for v in values]
    dtype = _common(values)
    if not dtype.fields:
        return spark.range(len(values)).select(F.struct(F.lit(0.0).alias("__dummy")).alias("datum"))
    return spark.createDataFrame([_fit(v, dtype) for v in values], dtype)


def from_any(spark: SparkSession, data) -> DataFrame:
    """A DataFrame from what users hold: Spark, pandas or polars frames, Arrow tables or streams, lists or dicts of rows."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.table(data)
    if isinstance(data, list):
        return from_values(spark, data)
    if isinstance(data, dict):
        return spark.createDataFrame(pa.table(data))
    if isinstance(data, pa.Table):
        return spark.createDataFrame(_decimals_off(data))
    if isinstance(data, pa.RecordBatch):
        return spark.createDataFrame(_decimals_off(pa.Table.from_batches([data])))
    if type(data).__module__.startswith("pandas"):
        plain = data.copy()
        for c in plain.columns:
            if str(plain[c].dtype) == "category":
                plain[c] = plain[c].astype(plain[c].cat.categories.dtype)
        return spark.createDataFrame(_decimals_off(pa.Table.from_pandas(plain, preserve_index=False)))
    if hasattr(data, "__arrow_c_stream__"):
        return spark.createDataFrame(_decimals_off(pa.RecordBatchReader.from_stream(data).read_all()))
    if hasattr(data, "to_arrow"):
        return spark.createDataFrame(_decimals_off(data.to_arrow()))
    raise TypeError(f"cannot read data from {type(data).__name__}")


def _decimals_off(table: pa.Table) -> pa.Table:
    """Decimals as doubles, dictionaries as their values."""
    for i, f in enumerate(table.schema):
        if pa.types.is_decimal(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(pa.float64()))
        elif pa.types.is_dictionary(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(f.type.value_type))
    return table
