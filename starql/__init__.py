"""A small analytics engine on PySpark."""
