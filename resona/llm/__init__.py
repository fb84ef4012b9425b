"""Operators of a training-data pipeline, and the registry of their queries."""

from __future__ import annotations
