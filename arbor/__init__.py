"""Vegetation-structure analytics as Spark DataFrame operators."""
