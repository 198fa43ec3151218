"""Operators over citation items, manuscripts and findings."""
