"""Column-level functions: text folding, tokenisation, arrays and spans."""
