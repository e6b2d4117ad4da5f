"""Spark operators for ledgers, JSON collections, page audits and document layout."""
