"""Sinks: frames as JSON rows, Arrow, pandas or polars."""

from __future__ import annotations

import base64
import math
from datetime import UTC, date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame


def json_value(x):
    """Times as UTC milliseconds, numbers that JSON lacks as null, nested values likewise."""
    if isinstance(x, datetime):
        return round((x if x.tzinfo else x.replace(tzinfo=UTC)).timestamp() * 1000)
    if isinstance(x, date):
        return round(datetime(x.year, x.month, x.day, tzinfo=UTC).timestamp() * 1000)
    if isinstance(x, float):
        return None if math.isnan(x) or math.isinf(x) else int(x) if x == int(x) and abs(x) < 2**53 else x
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, list | tuple):
        return [json_value(v) for v in x]
    if isinstance(x, dict):
        return {k: json_value(v) for k, v in x.items()}
    return x


def arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def rows(df: DataFrame) -> list[dict]:
    """All rows as JSON values; for results, which charts keep small."""
    return [{k: json_value(v) for k, v in r.items()} for r in arrow(df).to_pylist()]


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def converted(df: DataFrame, kind: str):
    """``df`` as spark, json, pyarrow, pandas, polars, arrow-ipc or arrow-ipc-base64."""
    match kind:
        case "spark":
            return df
        case "json":
            return rows(df)
        case "pyarrow" | "arro3" | "auto":
            return arrow(df)
        case "pandas":
            return arrow(df).to_pandas()
        case "polars":
            import polars

            return polars.from_arrow(arrow(df))
        case "arrow-ipc":
            return ipc(arrow(df))
        case "arrow-ipc-base64":
            return base64.b64encode(ipc(arrow(df))).decode()
    raise ValueError(f"unknown dataset format {kind!r}")
