"""grainsift: a Spark-first engine for curating text corpora and analysing model evaluations."""

from grainsift.session import get_session, load_tables

__all__ = ["get_session", "load_tables"]
