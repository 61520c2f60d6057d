"""Readers and writers: Parquet table handles, raw/clean CSV and Parquet, the HR
views derived from the TPC-H-style test data."""
