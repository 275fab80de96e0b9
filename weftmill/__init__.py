"""Weftmill: a Spark-first engine for web text, catalogues and training data."""
