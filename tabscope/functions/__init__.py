"""Column expressions: everything here is Catalyst, evaluated on the JVM."""
