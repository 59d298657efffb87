"""Readers for the star-schema tables and for tick-typed event views of them."""
