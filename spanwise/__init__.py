"""spanwise: retrieval-evaluation analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Undefined
metrics are NULL, never zero; every ranking has an explicit tie-break; no
operator relies on row order.
"""

__version__ = "0.1.0"
