"""Registered queries and their SQL."""

from quernstone.plans import catalogs, conversions, references, shapes, whole
from quernstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogs", "conversions", "references", "shapes", "whole"]
