"""rubrica: auditable ordinal measurement of messy text tables, on PySpark DataFrames."""
