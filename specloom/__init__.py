"""Specification-corpus analytics on Spark: search, hierarchy, versions, references, definitions, diffs."""
