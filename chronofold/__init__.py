"""chronofold: event-sourced workload analytics on Spark DataFrames."""
