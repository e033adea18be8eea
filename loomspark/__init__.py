"""Context selection and code-graph analytics on Spark."""

__version__ = "0.1.0"
