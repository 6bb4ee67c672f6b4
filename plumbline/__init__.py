"""A Spark-first engine for inspection analytics: measurement, anomaly scores and verdicts over DataFrames."""
