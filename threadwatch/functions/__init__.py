"""Column-level expressions (JVM-side unless stated otherwise)."""
