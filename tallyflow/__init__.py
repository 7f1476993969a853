"""Ledger-stream analytics and data-pipeline operators on Spark."""
