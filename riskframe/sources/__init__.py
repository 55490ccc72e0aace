"""Readers, writers, declared schemas and the case view over the test tables."""
