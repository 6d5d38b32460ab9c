"""Log sequences, anomaly detection and training data on Spark."""
