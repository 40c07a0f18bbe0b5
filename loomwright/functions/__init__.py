"""Column functions: text, numbers, arrays, JSON. All stay inside the JVM."""
