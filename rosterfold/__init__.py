"""Event-sourced directory data on Spark: gates, folds, lookups and streams over DataFrames."""
