"""Relational operators over baskets."""
