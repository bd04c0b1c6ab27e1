"""quern: corpus preparation, audit and analytics as declarative Spark plans."""

__version__ = "0.1.0"
