"""Column functions. They stay inside the JVM and never start a Python worker."""
