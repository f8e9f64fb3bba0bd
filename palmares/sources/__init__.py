"""Readers, writers, the table catalog and stored models."""
