"""Column expressions; every function here returns a Column and runs inside the JVM."""
