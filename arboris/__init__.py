"""Reconciliation of hierarchical data, and jobs around it, on Apache Spark."""
