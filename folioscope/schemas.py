"""Record schemas, and the strict reading of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

LABEL = "image string, document string, corpus string, labels map<string,boolean>, prelabel map<string,double>, derived map<string,double>, annotator string, timestamp string, duration_s double, notes string"
PRELABEL = "image string, document string, corpus string, scores map<string,double>, suggested map<string,boolean>, not_applicable array<string>, verdict string, quality_score double, width int, height int"
SYNTHETIC = "image string, reference string, document string, corpus string, labels map<string,boolean>, severities map<string,double>, steps array<struct<label:string,severity:double>>, seed bigint, masks map<string,string>, width int, height int"
PAGE = "path string, page int, height int, width int, dpi double, original_width int, original_height int, gray binary, error string"


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def score_ranges(column: str) -> F.Column:
    """All values of a score map are in 0..1."""
    return F.forall(F.map_values(F.coalesce(F.col(column), F.create_map().cast("map<string,double>"))), lambda x: (x >= 0) & (x <= 1))


def parse_strict(lines: DataFrame, ddl: str, required: list[str], checks: F.Column | None = None, value: str = "value") -> DataFrame:
    """r (the record) and ok: the line is a JSON object, has no key beyond the schema's, and what is required.

    Unknown keys make a line bad, as a typo would otherwise lose data silently.
    """
    known = F.array(*[F.lit(f.name) for f in struct(ddl).fields])
    clean = F.regexp_replace(F.col(value), "^﻿", "")
    parsed = lines.withColumn("r", F.from_json(clean, ddl, {"mode": "PERMISSIVE"})).withColumn("__keys", F.json_object_keys(clean))
    ok = F.col("__keys").isNotNull() & (F.size(F.array_except("__keys", known)) == 0)
    for name in required:
        ok = ok & F.col(f"r.{name}").isNotNull()
    parsed = parsed.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("__keys")
    return parsed if checks is None else parsed.withColumn("ok", F.col("ok") & F.coalesce(checks, F.lit(False)))
