"""Versioned, ordered key/value data as DataFrames."""
