"""The query language: text to syntax tree to DataFrame plan."""
