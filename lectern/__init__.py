"""lectern: learning analytics computed with PySpark DataFrames."""
