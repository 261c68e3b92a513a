"""sentrel: Spark-native payment monitoring analytics.

Every operator is a function from DataFrames to a DataFrame, shared by batch
and streaming callers; nothing here starts an action unless its docstring says so.
"""
