"""Conformance of declarative tables on Spark: typed cells, keys, references, containers, snapshots."""
