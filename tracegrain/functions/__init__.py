"""Column functions on names and label sequences."""
