"""Relational, graph, temporal and retrieval operators over DataFrames."""
