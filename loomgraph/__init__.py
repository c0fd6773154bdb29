"""loomgraph: code-graph analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame without hidden state.
"""
