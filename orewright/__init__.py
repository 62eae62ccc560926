"""orewright: text, graph, vector and stream analytics on Spark DataFrames."""

__version__ = "0.1.0"
