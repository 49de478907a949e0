"""The JSON query-plan language: validation and lowering to DataFrames."""
