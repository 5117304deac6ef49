"""Operators on flow graphs, as joins, aggregations and fixpoints."""
