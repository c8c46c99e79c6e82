"""Whole jobs: reconciliation, localization, reports, requests."""
