"""textquarry: document overlap, findings and submission life-cycle analysis on Spark DataFrames."""
