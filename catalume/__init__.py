"""Catalog audit and entity resolution on Spark."""
