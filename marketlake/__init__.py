"""marketlake: a PySpark-native engine for marketplace analytics.

Subpackages
-----------
sources    readers/writers: TESTDATA star adapter, CSV catalogs, change streams, sinks
functions  column functions: cleaners, dates, text helpers, transform registry
operators  DataFrame operators: predicates, versioning, catalog, orders, search, quality
plans      named reports and the query registry used by ``__spark_entry__``
streaming  Structured Streaming CDC pipeline and live report refresh
"""

__version__ = "0.1.0"
