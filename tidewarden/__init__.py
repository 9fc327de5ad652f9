"""Content-safety and corpus-preparation operators for Apache Spark.

Everything is DataFrame in, DataFrame out. ``operators`` holds the rule scans,
rewrites, scores and joins, ``sources`` the readers and sinks, ``functions``
the column helpers, ``plans`` the chains built from them and ``streaming`` the
Structured Streaming forms.
"""
