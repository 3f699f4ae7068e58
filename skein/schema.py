"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T

POINTS = "line_id bigint, pt_idx int, x double, y double, z double"
POINTS_IMPORTANCE = POINTS + ", importance double"
GRID = "col int, row int, layer int, u double, v double, w double"
CRITICAL_POINTS = "cp_id bigint, x double, y double, z double, type int, scale double"
EDGES = "line_id bigint, pt_idx int, nbr_line bigint, nbr_pt int, dist double"

POINT_KEY = ("line_id", "pt_idx")
EDGE_KEY = ("line_id", "pt_idx", "nbr_line", "nbr_pt")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
