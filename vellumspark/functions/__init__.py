"""Column functions: expressions over one row, evaluated inside the JVM unless a docstring says otherwise."""
