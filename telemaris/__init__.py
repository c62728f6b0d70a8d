"""telemaris: security-telemetry analytics as PySpark DataFrame operators."""
