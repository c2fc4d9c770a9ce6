"""Content-similarity analytics on PySpark."""
