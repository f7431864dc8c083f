"""Column builders shared by the operators; no Python UDFs."""
