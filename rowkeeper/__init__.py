"""Table operators for data operations, written as plain Spark DataFrame code."""
