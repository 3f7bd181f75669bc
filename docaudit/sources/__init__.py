"""Readers, schemas and policy tables."""
