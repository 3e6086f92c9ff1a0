"""Column functions: text, paths, languages and secrets. All stay in the JVM."""
