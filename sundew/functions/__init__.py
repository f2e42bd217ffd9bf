"""Column functions: no shuffles, all inside generated code."""
