"""Routing-data analytics as plain DataFrame operators for Apache Spark."""
