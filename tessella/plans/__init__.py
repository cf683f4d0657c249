"""The pipeline language, its compiler to DataFrames, and the fluent builder."""
