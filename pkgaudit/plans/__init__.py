"""Whole scans put together from the operators."""
