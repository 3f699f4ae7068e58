"""Round trips through the file formats, and grouping of rows into lines."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from skein.queries.base import POINTS, query, rounded, s6, with_ctes
from skein.session import ensure_checkpoint_dir
from skein.sources import binary, text
from skein.sources.tables import event_points


def _scratch(spark, suffix: str) -> str:
    """A new path in the shared folder of the session."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return os.path.join("/" + folder.lstrip("/"), f"{uuid.uuid4().hex}{suffix}")


@query("bsl_roundtrip", with_ctes(POINTS, select=f"""
SELECT dense_rank() OVER (ORDER BY line_id) - 1 AS line_id, pt_idx, {s6('x::FLOAT::DOUBLE', 'x')},
  {s6('y::FLOAT::DOUBLE', 'y')}, {s6('z::FLOAT::DOUBLE', 'z')} FROM points"""))
def bsl_roundtrip(spark, folder):
    path = _scratch(spark, ".bsl")
    binary.write_bsl(event_points(spark, folder), path)
    return rounded(binary.read_bsl(spark, path, records="4096").drop("file"), "x", "y", "z")


@query("obj_roundtrip", with_ctes(POINTS, select="""
SELECT dense_rank() OVER (ORDER BY line_id) - 1 AS line_id, pt_idx, ROUND(x + 1e-9, 4) + 0e0 AS x,
  ROUND(y + 1e-9, 4) + 0e0 AS y, z FROM points"""))
def obj_roundtrip(spark, folder):
    path = _scratch(spark, ".obj")
    points = event_points(spark, folder)
    exact = points.withColumns({c: F.round(F.col(c) + F.lit(1e-9), 4) + F.lit(0.0) for c in "xy"})
    text.write_obj(exact, path)
    return text.read_obj(spark, path, as_one=True).drop("file")


@query("gap_island_lines", with_ctes(POINTS, """marked AS (
  SELECT *, CASE WHEN z IS NOT DISTINCT FROM lag(z) OVER w THEN 0 ELSE 1 END AS fresh
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
runs AS (SELECT *, CAST(SUM(fresh) OVER (PARTITION BY line_id ORDER BY pt_idx) - 1 AS BIGINT) AS run FROM marked)""",
  select="""SELECT line_id AS source, run AS line_id,
  CAST(row_number() OVER (PARTITION BY line_id, run ORDER BY pt_idx) - 1 AS INTEGER) AS pt_idx, x, y, z FROM runs"""))
def gap_island_lines(spark, folder):
    rows = event_points(spark, folder).withColumn("row", F.col("pt_idx").cast("bigint")).select(
        F.col("line_id").alias("file"), "row", "x", "y", "z", F.col("z").alias("kind")
    )
    return text.group_runs(rows, "kind").withColumnRenamed("file", "source")
