"""Column builders: vector functions and metadata predicates."""
