"""Work-item analytics expressed as PySpark DataFrame operators."""
