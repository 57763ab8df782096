"""Storage: the commit log of a heap."""
