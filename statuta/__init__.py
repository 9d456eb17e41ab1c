"""Statuta: retrieval and analytics over regulation-style corpora, as Spark DataFrame jobs."""
