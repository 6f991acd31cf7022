"""Listings analytics expressed as Spark DataFrame plans."""
