"""pricelens: Spark-native analytics for entity x item x date -> value price panels.

Every operator takes and returns Spark DataFrames.  Column names are keyword
arguments whose defaults are the canonical panel names
(``City``, ``Commodity``, ``Date``, ``Price``).
"""

__version__ = "0.1.0"
