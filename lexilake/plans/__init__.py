"""Whole jobs: what a user runs, composed from operators."""
