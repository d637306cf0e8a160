"""Spark-native quantitative equity research library.

Every operator takes DataFrames and returns a lazy DataFrame; Spark plans,
shuffles and executes all of the work.
"""
