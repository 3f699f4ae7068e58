"""Registered queries and the SQL that states what each has to return."""

from skein.queries import (  # noqa: F401
    bundling_queries,
    field_queries,
    geometry_queries,
    lsh_queries,
    opacity_queries,
    ranking_queries,
    search_queries,
    segment_queries,
    similarity_queries,
    source_queries,
)
from skein.queries.base import ORACLES, QUERIES  # noqa: F401
