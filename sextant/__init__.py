"""Opportunity and news analytics as plain PySpark DataFrame operators."""
