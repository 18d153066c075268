"""Column -> Column functions, all JVM-side."""
