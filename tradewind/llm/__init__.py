"""Operators for preparing training text: filters, deduplication, archives, tokens and scans."""
