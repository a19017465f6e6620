"""Column functions: scores, similarities and text rules, all built-in expressions."""
