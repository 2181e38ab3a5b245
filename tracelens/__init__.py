"""tracelens: issue-to-code traceability as Spark DataFrame jobs."""

__version__ = "0.1.0"
