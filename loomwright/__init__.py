"""Loomwright: ranking, fusion, evaluation and versioned code history on Spark DataFrames."""
