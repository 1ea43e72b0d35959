"""Column functions: each takes and returns Spark columns and runs inside code generation."""
