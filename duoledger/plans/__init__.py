"""Ledger plans."""
