"""Message-log analytics on Spark: batch and streaming operators over broker logs."""

__version__ = "0.1.0"
