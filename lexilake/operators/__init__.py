"""Relational operators: each takes and returns DataFrames and runs no action unless it says so."""
