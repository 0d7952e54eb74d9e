"""Document-log and vector analytics on Spark: declarative operators over an append-only change log."""

__version__ = "0.1.0"
