"""Temporal entity-attribute analytics as lazy Spark DataFrame transformations."""
