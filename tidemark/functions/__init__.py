"""Column functions: pure expressions, no actions."""
