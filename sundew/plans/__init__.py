"""Helpers for physical layout: shared tables and distributed ranks."""
