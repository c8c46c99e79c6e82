"""Stages of the reconciliation, each a function of DataFrames and a profile."""
