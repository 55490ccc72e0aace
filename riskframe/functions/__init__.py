"""Column-level helpers: null rules, scalar expressions, hash draws, special functions."""
