"""Pagemill: document engineering and data preparation as Spark DataFrame work."""
