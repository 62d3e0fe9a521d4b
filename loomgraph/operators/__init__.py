"""Graph, vector, text and geo operators over DataFrames."""
