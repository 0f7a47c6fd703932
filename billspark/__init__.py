"""billspark: a PySpark-native engine for billing statements, reviews of answers about them, and their texts.

Operators are functions from DataFrames to DataFrames; nothing is collected inside an operator unless its
docstring names the bound of what is collected.
"""

__version__ = "0.1.0"
