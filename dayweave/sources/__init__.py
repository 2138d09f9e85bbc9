"""Readers that turn raw exports into typed DataFrames."""
