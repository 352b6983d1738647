"""Customer-churn analytics as Spark jobs.

Sub-packages:
  sources    - table readers, the customer CSV reader, the profile builder
  functions  - column expressions (bins, rule terms, safe statistics)
  operators  - DataFrame -> DataFrame jobs (features, profiling, rules, segments)
  ml         - pyspark.ml training, clustering, evaluation and explanation
  plans      - the named queries and their SQL twins
  streaming  - Structured Streaming scoring and activity monitoring
"""

__version__ = "0.1.0"
