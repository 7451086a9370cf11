"""Named preprocessing plans and the registry of queries."""
