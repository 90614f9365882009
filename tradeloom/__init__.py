"""Marketplace and ledger analytics as PySpark DataFrame operators."""
