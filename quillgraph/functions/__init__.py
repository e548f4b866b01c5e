"""Column functions: the expression compiler, exact decimals and identities."""
