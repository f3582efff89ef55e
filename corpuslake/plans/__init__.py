"""Plans that put operators together, and the query catalogue."""
