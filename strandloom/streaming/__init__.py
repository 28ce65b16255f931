"""Fragments that keep arriving."""
