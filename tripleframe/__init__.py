"""Knowledge-triple data work as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is computed until the caller
writes or collects.  See README.md for the map of operators to modules.
"""

__version__ = "0.1.0"
