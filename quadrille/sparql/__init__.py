"""SPARQL text to algebra to DataFrames."""
