"""Portable plans: one SQL text for Spark and for the oracle engine."""
