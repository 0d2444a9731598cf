"""Registered queries: fixture views (Spark and SQL), query modules and the registry."""
