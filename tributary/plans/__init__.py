"""How recursive queries are run: fixpoints over written deltas."""
