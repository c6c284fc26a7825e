"""samplewell: sensor time-series analytics on PySpark DataFrames."""
