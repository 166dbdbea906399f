"""Reductions over streams of vector elements."""
