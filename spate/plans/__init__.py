"""Composite plans (C1-C4) and the registry of runnable queries over the driver tables."""
