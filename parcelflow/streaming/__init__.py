"""Structured Streaming jobs over tracking pushes."""
