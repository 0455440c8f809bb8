"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
