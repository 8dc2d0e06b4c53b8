"""Whole jobs: operators chained into the flows a user runs."""
