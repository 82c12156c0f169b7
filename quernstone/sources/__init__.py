"""Readers: workbooks, prototypes of calls, emitted documents."""
