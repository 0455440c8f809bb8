"""Column-expression builders. Everything here returns a Spark ``Column`` and stays JVM-side."""
