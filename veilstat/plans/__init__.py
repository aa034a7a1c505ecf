"""Whole jobs, composed of operators and functions."""
