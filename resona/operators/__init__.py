"""Operators on signals, frames, intervals and series."""
