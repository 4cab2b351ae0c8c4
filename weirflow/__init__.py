"""Typed batch dataflows on PySpark."""
