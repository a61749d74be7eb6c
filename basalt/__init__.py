"""Basalt: a warehouse-dialect analytics engine expressed with Spark DataFrames, Spark SQL and Catalyst."""

from basalt.session import session

__all__ = ["session"]
