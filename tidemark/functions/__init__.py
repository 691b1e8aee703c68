"""Column functions: every one is built from Spark functions and stays in the JVM."""
