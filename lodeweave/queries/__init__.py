"""Queries of the core operators for __spark_entry__."""
