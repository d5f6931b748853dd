"""Text-sentiment analytics as PySpark operators: plain functions over DataFrames and Columns."""
