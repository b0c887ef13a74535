"""Plumbing shared by several operators."""
