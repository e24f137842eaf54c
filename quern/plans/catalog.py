"""Every registered query of the library with its DuckDB twin."""

from quern.plans import (  # noqa: F401  importing registers
    table_queries,
    text_queries,
    chunk_queries,
    scope_queries,
    pipeline_queries,
    retrieval_queries,
    graph_queries,
    source_queries,
    drive_queries,
    split_queries,
)
from quern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_search"
