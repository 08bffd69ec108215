"""Planning of searches."""
