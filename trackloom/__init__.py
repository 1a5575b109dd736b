"""Bulk analysis and repair of recorded routes on Spark."""
