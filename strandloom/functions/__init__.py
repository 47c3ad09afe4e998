"""Column builders: sequences, strings, statistics, variants."""
