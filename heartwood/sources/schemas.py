"""Schema documents: which ones a folder holds, and a document made from typed tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EDGES, ENUMS, KINDS
from ..operators.validate import required_rules

#: The versions that have a schema.
VERSIONS = ["5.0", "5.1", "5.2", "6.0"]


def list_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """(version, local): the known versions and those that files ``schema-<version>.json`` of
    the folder have; a folder that isn't there has none. Downloading is not part of this."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []  # one folder's names
    have = {m[1] for n in names if (m := re.fullmatch(r"schema-(.+)\.json", n))}
    return spark.createDataFrame([(v, v in have) for v in sorted({*VERSIONS, *have})], "version string, local boolean").orderBy("version")


def _field(name: str, kind: T.DataType) -> dict:
    if isinstance(kind, T.ArrayType):
        inner = _field(name, kind.elementType)
        return {"type": "array", "items": inner["type"]} | ({"fields": inner["fields"]} if "fields" in inner else {})
    if isinstance(kind, T.StructType):
        return {"type": "struct", "fields": {f.name: _field(f.name, f.dataType) for f in kind.fields}}
    if name == "ref" or name.endswith(("_handle", "_handles")) or name in ("citation_list", "note_list", "media_list", "tag_list"):
        return {"type": "handle"}
    simple = {T.IntegerType: "integer", T.LongType: "integer", T.BooleanType: "boolean", T.DoubleType: "number"}
    return {"type": simple.get(type(kind), "string")}


def extract_schema(tables: dict[str, DataFrame], version: str) -> dict:
    """The document of typed tables by kind: fields with types, required ones, the edges that
    leave each kind with their targets, and the enumerations."""
    kinds = {}
    for kind, rows in tables.items():
        if kind not in KINDS:
            raise ValueError(f"{kind} is no kind")
        fields = {f.name: _field(f.name, f.dataType) for f in rows.schema}
        kinds[kind] = {"fields": fields, "required": [f for f in required_rules()[kind] if f in fields], "edges": {e: t for e, t in EDGES.items() if e.startswith(kind)}}
    return {"version": version, "kinds": kinds, "enums": {k: list(v) for k, v in ENUMS.items()}}


def unknown_enum_values(tables: dict[str, DataFrame], columns: dict[str, dict[str, str]]) -> DataFrame:
    """(kind, field, value, n): values outside the enumeration that ``columns`` names for a
    field, as {kind: {field: enumeration}}; null is none."""
    out = None
    for kind, fields in columns.items():
        for field, enum in fields.items():
            rows = tables[kind].select(F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.col(field).cast("string").alias("value")).filter(F.col("value").isNotNull() & ~F.col("value").isin(ENUMS[enum]))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no columns to check")
    return out.groupBy("kind", "field", "value").agg(F.count("*").alias("n"))
