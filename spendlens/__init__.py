"""Campaign analytics on Spark DataFrames: ingest, benchmarks, dashboards, churn risk and trajectories."""
