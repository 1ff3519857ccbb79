"""Versioned stores: several tables and a note that become visible together.

A version's tables are written to a folder of their own; then its manifest, which names them with their schemas and holds the note, is put in place by one
rename. Readers follow the manifest of the highest number, so they see a version whole or not at all; a write that fails leaves the one before
readable. One writer at a time; paths are those of the file system that Spark uses.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS = "manifests"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file in place whole, by a rename; False if one is there already."""
    fs, final = _fs(spark, path)
    if fs.exists(final):
        return False
    _, part = _fs(spark, f"{path.rsplit('/', 1)[0]}/_part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return fs.rename(part, final)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    fs, p = _fs(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], note: Mapping | None = None, partition: Mapping[str, list[str]] | None = None) -> int:
    """Writes the tables and makes them the current version; its number. `partition` names columns by which a table's files are parted."""
    root, version = root.rstrip("/"), uuid.uuid4().hex
    for name, df in tables.items():
        by = (partition or {}).get(name, [])
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{root}/data/{version}/{name}")
    said = json.dumps({"version": version, "tables": {name: json.loads(df.schema.json()) for name, df in tables.items()}, "note": dict(note or {})}, ensure_ascii=False)
    number = max(_numbers(spark, root), default=0) + 1
    if not put_text(spark, f"{root}/{MANIFESTS}/{number:08d}.json", said):
        raise FileExistsError(f"version {number} of {root} was written by another run")
    return number


def current(spark: SparkSession, root: str, number: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables and the note of the current version, or of a number."""
    root = root.rstrip("/")
    known = _numbers(spark, root)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no version {number or ''} in {root}".replace("  ", " "))
    said = json.loads(get_text(spark, f"{root}/{MANIFESTS}/{known[-1] if number is None else number:08d}.json"))
    read = lambda name, schema: spark.read.schema(StructType.fromJson(schema)).parquet(f"{root}/data/{said['version']}/{name}")
    return {name: read(name, schema) for name, schema in said["tables"].items()}, said["note"]
