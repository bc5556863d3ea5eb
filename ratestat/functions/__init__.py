"""Column-level helpers: fixed values, hash draws and distribution tails."""
