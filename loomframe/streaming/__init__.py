"""Keyed state: wear and care, circuit breakers, ingestion."""
