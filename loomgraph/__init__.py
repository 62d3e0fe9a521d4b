"""loomgraph: property-graph, vector, text and geo analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
