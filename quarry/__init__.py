"""quarry: Spark-native operators for web-log token analytics, a star-schema
warehouse with its data-quality checks, and tabular profiling / modelling.

Every operator takes and returns Spark DataFrames; planning and execution are
left to Catalyst, AQE and Spark ML.
"""

__version__ = "0.1.0"
