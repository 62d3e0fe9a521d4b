"""The page graph and search over it."""
