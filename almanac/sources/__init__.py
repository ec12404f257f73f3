"""Readers and writers with explicit schemas and idempotent partition replacement."""
