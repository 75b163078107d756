"""End-to-end plans and the named query catalogue."""
