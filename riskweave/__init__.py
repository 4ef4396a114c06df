"""riskweave: application-risk analytics written as Spark DataFrame jobs.

Sub-packages:
  sources    scans, sinks and the driver-table fixtures
  functions  column expressions (parsing, safe arithmetic, quantile helpers)
  operators  DataFrame -> DataFrame operators (validation, labels, splits,
             features, velocity, graph, encoders, evaluation, drift, scoring)
  plans      fitted pipelines, models and end-to-end jobs
  streaming  Structured Streaming scoring
"""

__version__ = "0.1.0"
