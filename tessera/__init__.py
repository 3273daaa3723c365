"""Spark jobs for versioned text corpora: state tables, indexes, search, evidence and audit."""
