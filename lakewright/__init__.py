"""Lakewright: a Spark-native engine for multilingual evidence analytics.

Every operator is a function from DataFrames to a DataFrame; nothing here
starts an action unless its docstring says so.
"""

__version__ = "0.1.0"
