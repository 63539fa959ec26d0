"""Operators for preparing training text: cleaning, grouping, scoring, packing and sharding documents."""
