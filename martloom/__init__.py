"""Marts, models and quality gates for transactional star schemas, on Spark."""
