"""Tidemark: continuously updated columnar tables and corpus operators on Spark."""
