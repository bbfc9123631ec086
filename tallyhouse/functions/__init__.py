"""Column functions; all of them compile to JVM expressions."""
