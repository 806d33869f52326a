"""Evaluation analytics and text preparation on Spark DataFrames."""
