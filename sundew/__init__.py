"""Attack-telemetry analytics as DataFrame-in, DataFrame-out functions on Spark."""
