"""Readers, writers, state tables and schema adaptors."""
