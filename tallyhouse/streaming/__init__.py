"""Listings that arrive in pieces."""
