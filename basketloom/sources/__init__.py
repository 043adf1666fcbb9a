"""Readers and writers of the text formats that baskets travel in."""
