"""Operators over the canonical event table: DataFrame in, DataFrame out."""
