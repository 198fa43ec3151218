"""Readers of reference formats into items, and writers from them."""
