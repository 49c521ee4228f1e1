"""Readers of ledger tables, text records and quote feeds."""
