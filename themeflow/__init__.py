"""themeflow: Spark-native analytics for threaded discussions.

Items (posts and comments) and their annotations are plain DataFrames; every
operator is a DataFrame -> DataFrame function that runs as a Spark plan.
"""

__version__ = "0.1.0"
