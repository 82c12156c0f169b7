"""Operators over tables of cells, keys, references, containers and snapshots."""
