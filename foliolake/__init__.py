"""Document-evidence analytics on Spark.

Every public operator takes DataFrames and returns a DataFrame.  See README.md
for the map from operator families to modules.
"""

__version__ = "0.1.0"
