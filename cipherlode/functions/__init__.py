"""Column functions over names, words and values."""
