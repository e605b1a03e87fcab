"""cobbler: catalogue analytics as lazily composed PySpark DataFrame plans."""
