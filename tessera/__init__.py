"""Tessera: a PySpark-native engine for nested values, property graphs and evolving records.

Every operator takes DataFrames and returns DataFrames.  The packages are

``operators``  graph, retrieval, diff/evolution/validation and ordered-data operators
``functions``  scalar expressions (hashing, text, numeric codecs, versions, decimals)
``sources``    Spark data sources and sinks for the wire and text formats
``streaming``  Structured Streaming state machines
``plans``      the query catalogue: each query with the SQL it is checked against
"""

__version__ = "0.1.0"
