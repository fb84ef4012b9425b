"""The catalogue of queries."""

from . import scores, spectra, timing, views  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
