"""Points from tables, and indexes on disk."""
