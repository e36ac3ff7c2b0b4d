"""scoreplane: Spark-native analytics for scored-entity, text-rule and log tables.

Every operator is a function from DataFrames (plus plain arguments) to a
DataFrame, built from native Spark expressions, joins and aggregations.
"""

__version__ = "0.1.0"
