"""Column functions over genes and baskets."""
