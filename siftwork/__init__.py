"""Content-intelligence analytics as composable PySpark DataFrame operators."""
