"""Settings and artefacts, found by the driver: small files, read once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from .regions import row_count


def _text(spark: SparkSession, path: str) -> str | None:
    """A small file by any path that Spark can read; None where it is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def settings(spark: SparkSession, path: str, defaults: Mapping, env: Mapping[str, str] | None = None, key: str | None = None) -> dict:
    """Defaults, overlaid by a JSON file (its object ``key`` if given) and by environment variables of the names in upper case, in the defaults' types."""
    text = _text(spark, path)
    found = json.loads(text) if text else {}
    found = found.get(key, {}) if key else found
    env = os.environ if env is None else env
    out = {}
    for name, value in defaults.items():
        value = found.get(name, value)
        if name.upper() in env:
            raw, kind = env[name.upper()], type(defaults[name])
            value = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        out[name] = value
    return out


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    """The first path that is there; a path may be a glob, of which the least match counts."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        got = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if got:
            return min(s.getPath().toString() for s in got)
    return None


def latest_checkpoint(names: Iterable[str]) -> str | None:
    """The name whose last number is greatest."""
    numbered = [(int(re.findall(r"\d+", n)[-1]), n) for n in names if re.search(r"\d", n)]
    return max(numbered)[1] if numbered else None


def most_progress(spark: SparkSession, paths: Iterable[str]) -> str | None:
    """The log with most lines, the first on ties; None if all are empty."""
    counts = [(row_count(spark, p), -i, p) for i, p in enumerate(paths)]
    best = max(counts, default=(0, 0, None))
    return best[2] if best[0] else None
