"""Spark jobs for catalogue, text-corpus and workflow tables."""
