"""Ledger functions."""
