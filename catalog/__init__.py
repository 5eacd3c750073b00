"""Registered queries: each pairs a Spark function with SQL that must give the same rows."""
