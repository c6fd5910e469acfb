"""semaloom: semantic retrieval over code and text, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
