"""Scalar functions as Column expressions; nothing here leaves the JVM."""
