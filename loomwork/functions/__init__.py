"""Column expressions: text, JSON and array helpers that stay inside the JVM."""
