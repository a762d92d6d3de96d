"""paddock: race-result analytics as Spark DataFrame operators."""
