"""Readers, stores and adapters from plain tables to the engine's records."""
