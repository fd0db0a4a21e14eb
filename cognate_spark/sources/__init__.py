"""Readers into the canonical schemas, and writers from them."""
