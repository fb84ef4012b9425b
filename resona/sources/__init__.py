"""Readers, writers and the roles that tables are read in."""
