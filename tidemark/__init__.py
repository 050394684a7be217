"""Time-series strategy analytics as PySpark DataFrame operators."""
