"""Registered queries, their SQL, and the staged validation run."""
