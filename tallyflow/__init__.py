"""Network-flow profiling, training and anomaly detection as Spark jobs."""
