"""Graph operators: filters, reduction, traversal, features, propagation, ranking, sequences, labels, metrics."""
