"""rillspark: Spark-native analytics over environmental time series.

The package is a set of lazy DataFrame operators.  Every public function takes
DataFrames or Columns and returns a DataFrame or Columns; nothing here collects
rows that grow with the input.
"""

__version__ = "0.1.0"
