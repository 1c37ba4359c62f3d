"""Column expressions: no joins, no shuffles, no Python at run time."""
