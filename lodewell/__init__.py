"""lodewell: a PySpark-native engine for versioned, checksummed, forensic data.

Every public function takes DataFrames and returns DataFrames (or Columns);
nothing here starts a SparkSession of its own.
"""

__version__ = "0.2"
