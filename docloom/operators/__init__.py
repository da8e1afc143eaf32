"""Relational operators: joins by position, folds, clusters, placement."""
