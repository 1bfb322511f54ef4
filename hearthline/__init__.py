"""Household-registry analytics as lazy Spark DataFrame operators."""
