"""Spark-native analytics for posts and comments.

Every operator takes DataFrames (lookup tables included) and returns a DataFrame.
"""
