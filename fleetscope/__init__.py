"""Fleet-wide architecture recovery on PySpark DataFrames."""
