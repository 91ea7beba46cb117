"""Operators on DataFrames: validation, matching, state, upserts and workflows."""
