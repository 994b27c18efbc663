"""Array and table analytics on Spark: n-dimensional arrays as long-form DataFrames."""
