"""Operators that prepare training text at scale, their queries and SQL twins."""
