"""Registered queries: one Spark plan and one DuckDB oracle text per operator."""
