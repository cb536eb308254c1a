"""Readers, writers and source-code extractors."""
