"""Operators on DataFrames: reporting, listing, joins, changes of tables, events and page layout."""
