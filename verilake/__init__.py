"""verilake: Spark jobs over biometric-verification data."""
