"""Readers, writers and paged web sources."""
