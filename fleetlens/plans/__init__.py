"""Partitioning helpers shared by the operators."""
