"""Column functions; all of them stay JVM-side."""
