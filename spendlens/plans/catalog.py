"""Every named query. Importing the query modules fills the registry."""

from . import (  # noqa: F401
    benchmark_queries,
    book_queries,
    operations_queries,
    performance_queries,
    risk_queries,
    trajectory_queries,
)
from .registry import ORACLE, QUERIES  # noqa: F401
