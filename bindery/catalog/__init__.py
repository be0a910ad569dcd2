"""Runnable queries over the standard tables, with SQL equivalents."""
