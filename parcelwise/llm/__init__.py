"""Operators for large training-data pipelines, with their registered queries."""
