"""Baskets and events as streams."""
