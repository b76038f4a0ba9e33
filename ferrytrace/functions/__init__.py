"""Column functions: everything stays in built-in expressions."""
