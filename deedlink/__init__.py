"""deedlink: record linkage and sales enrichment as Spark DataFrame operators."""

__version__ = "0.1.0"
