"""Column expressions: numbers, text and times. All are built-in Spark expressions."""
