"""Scalar functions: columns from built-in expressions, and plain Python for the few that built-ins can't say."""
