"""Ordered, classified and ledger transforms; every function maps DataFrames to DataFrames."""
