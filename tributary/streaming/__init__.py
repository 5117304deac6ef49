"""Graphs maintained from event streams."""
