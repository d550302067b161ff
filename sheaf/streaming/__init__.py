"""Streaming form of the row-wise stages."""
