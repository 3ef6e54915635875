"""docforge: documents and web pages to instruction-tuning datasets, on Spark."""

__version__ = "0.1.0"
