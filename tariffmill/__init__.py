"""A PySpark engine for price-list ingestion, matching, state and analytics."""
