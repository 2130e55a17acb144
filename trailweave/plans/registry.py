"""Queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import domain, flows, relational, tracks  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
