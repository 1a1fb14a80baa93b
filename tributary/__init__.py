"""Tributary: record linkage and analytics on the Spark DataFrame API."""
