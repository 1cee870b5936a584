"""Readers, writers and the bindings of the given tables."""
