"""Retail analytics as whole-table Spark jobs."""
