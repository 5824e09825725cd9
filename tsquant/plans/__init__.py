"""Whole jobs, and the queries over the shared tables with their SQL."""
