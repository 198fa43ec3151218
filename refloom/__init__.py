"""refloom: reference-list and document analytics as Spark plans."""
