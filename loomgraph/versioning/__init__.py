"""Upserts, commits, diffs, merges and overlays."""
