"""riskframe — clinical-risk analytics as Spark DataFrame jobs.

Sub-packages:
  functions  column expressions (hashed RNG, safe ratios, bands, formatting)
  sources    table scans, patient CSV/JSON readers, stand-in views, sinks
  operators  features, splits, preprocessing, metrics, neighbours, clustering,
             anomaly detectors, estimators, explanations
  plans      composed plans: cascade scoring, jobs, the query catalogue
  streaming  file-stream scoring
"""

__version__ = "0.1.0"
