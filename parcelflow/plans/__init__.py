"""Registered queries: each a DataFrame plan over the driver's tables, with the same question in SQL."""
