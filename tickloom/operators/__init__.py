"""Operators as DataFrame transformations, each module with its queries and their SQL."""
