"""Document accessibility analytics on Spark.

``functions``  column expressions (URLs, text, triage, display)
``sources``    readers and policy tables
``operators``  DataFrame in, DataFrame out
``plans``      composed jobs, fixtures and the query catalogue
``streaming``  Structured Streaming forms of the incremental jobs
"""
