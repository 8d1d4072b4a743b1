"""Review analytics as plain PySpark DataFrame operators."""
