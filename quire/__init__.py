"""quire: a PySpark engine for collections of documents."""

__version__ = "0.1.0"
