"""Vector and metadata analytics as Spark plans."""
