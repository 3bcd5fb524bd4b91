"""Scans: JSON lines, Parquet, CSV, configs, and dataset specs."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.sampling import limit_splits, merge_splits


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON lines without broken ones and those that lack the key; a missing path is an empty table."""
    try:
        found = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return found.where(F.col(key).isNotNull()).drop("_corrupt_record")


def read_translated(spark: SparkSession, path: str, schema: str, column: str = "hi") -> DataFrame:
    """JSON lines that have a text in a column."""
    return spark.read.schema(schema).json(path).where(F.col(column).isNotNull() & (F.col(column) != ""))


def read_first(spark: SparkSession, path: str, schema: str, n: int, order: str) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(order).limit(n)


def random_row(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One row, each as likely (a probe of bytes would favour rows after long ones)."""
    return df.orderBy(F.xxhash64(key, F.lit(seed))).limit(1)


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Only the given files."""
    return spark.read.parquet(*paths)


def read_configs(spark: SparkSession, base: str, configs: list[str]) -> DataFrame:
    """All configs, one folder each, appended."""
    return reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(f"{base}/{c}").withColumn("config", F.lit(c)) for c in configs])


def read_strings_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with declared string columns, so leading zeros stay."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, content) of answered requests; blank lines and errors are left out."""
    schema = "custom_id string, error string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
    rows = spark.read.schema(schema).json(path).where("custom_id is not null and error is null")
    return rows.select("custom_id", F.trim(F.coalesce(F.get("response.body.choices", F.lit(0))["message"]["content"], F.lit(""))).alias("content"))


def resolve_path(path: str, variable: str) -> str:
    """An absolute or existing path as it is, else below the folder that the environment names."""
    if os.path.isabs(path) or os.path.exists(path):
        return path
    base = os.environ.get(variable)
    if base and os.path.exists(os.path.join(base, path)):
        return os.path.join(base, path)
    raise FileNotFoundError(path)


def merge_settings(base: dict, own: dict) -> dict:
    """Nested settings, the second over the first."""
    out = dict(base)
    for k, v in own.items():
        out[k] = merge_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(path: str) -> dict:
    """A YAML file over the one it ``extends``, and so on."""
    import yaml

    own = yaml.safe_load(Path(path).read_text()) or {}
    parent = own.pop("extends", None)
    return merge_settings(load_settings(str(Path(path).parent / parent)), own) if parent else own


def _value(text: str) -> str | int:
    return int(text.replace("_", "")) if re.fullmatch(r"\d[\d_]*", text) else text


def parse_spec(spec: str) -> tuple[str | None, dict[str, str | int]]:
    """``name[k:v,k:v]`` or ``a=1,b=2`` as (name, options); numbers may have ``_``. In brackets a number wins over a word of the same key."""
    spec = spec.strip()
    if m := re.fullmatch(r"([^\[\]]*)\[(.*)\]", spec, re.S):
        options: dict[str, str | int] = {}
        for part in filter(None, map(str.strip, m[2].split(","))):
            k, colon, v = part.partition(":")
            if not colon or not k.strip() or not v.strip():
                raise ValueError(f"no key:value in {part!r}")
            new = _value(v.strip())
            if not (isinstance(options.get(k.strip()), int) and isinstance(new, str)):
                options[k.strip()] = new
        return m[1].strip() or None, options
    if "=" in spec:
        options = {}
        name = None
        for part in filter(None, map(str.strip, spec.split(","))):
            k, equals, v = part.partition("=")
            if not equals:
                raise ValueError(f"no key=value in {part!r}")
            if k.strip() == "name":
                name = v.strip()
            else:
                options[k.strip()] = _value(v.strip())
        return name, options
    return spec or None, {}


def split_specs(text: str) -> list[str]:
    """The specs of ``A + B | C``."""
    return [s.strip() for s in re.split(r"[|+]", text) if s.strip()]


def name_fits(name: str, wanted: str | list[str]) -> bool:
    """Whether the name ends with or contains one of the wanted."""
    return any(w in name for w in ([wanted] if isinstance(wanted, str) else wanted))


def load_mixture(spec: str, load: Callable[[str], dict[str, DataFrame]], order: str, overlap: bool = False) -> dict[str, DataFrame]:
    """Splits of all datasets in a spec, each limited as its options say. ``load`` gives a name's splits."""
    parts = []
    for one in split_specs(spec):
        name, options = parse_spec(one)
        limits = {k: v for k, v in options.items() if isinstance(v, int)}
        parts.append(limit_splits(load(name or ""), limits, order, overlap) if limits else load(name or ""))
    return merge_splits(parts)
