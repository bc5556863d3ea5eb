"""ratestat: Spark-native operators for rating and survey tables.

Every operator takes DataFrames and returns a DataFrame.  Row work runs as
Spark jobs; only fixed-size results (a few sums, a p x p matrix) are ever
brought to the driver.
"""

__version__ = "0.1.0"
