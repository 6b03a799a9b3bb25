"""Tidewater: a pipeline query language, a SQL subset and a table store on Spark."""

__version__ = "0.1.0"
