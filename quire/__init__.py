"""quire: a document knowledge-base analytics engine on PySpark."""

__version__ = "0.1.0"
