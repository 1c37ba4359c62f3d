"""Dependency audit over tables: every operator takes DataFrames and returns DataFrames."""
