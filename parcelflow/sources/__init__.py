"""Readers of uploads (CSV, xlsx, zip) and writers of exports."""
