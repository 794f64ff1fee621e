"""Retrieval over large collections of legal texts, planned by Spark."""
