"""Matching as profiles and offers arrive."""
