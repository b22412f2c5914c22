"""Instrument catalogues from YAML."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("symbol", "provider", "instrument_type", "currency", "exchange_timezone", "session_calendar", "is_continuous", "enabled")


def load_catalogue(spark: SparkSession, text: str, key: str = "instruments") -> DataFrame:
    """The catalogue in a YAML document: known keys as columns, others as JSON in ``metadata_json``. A symbol that comes twice, whatever its case, is an error."""
    import yaml

    rows = (yaml.safe_load(text) or {}).get(key) or []
    names = [str(r["symbol"]).upper() for r in rows]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"symbols given twice: {', '.join(twice)}")
    kinds = {"is_continuous": "boolean", "enabled": "boolean"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS) + ", metadata_json string"
    known = [tuple(r.get(c, True if c == "enabled" else None) for c in COLUMNS) + (json.dumps({k: v for k, v in r.items() if k not in COLUMNS}, default=str, sort_keys=True),) for r in rows]
    return spark.createDataFrame(known, schema)
