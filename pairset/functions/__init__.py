"""Column builders: Column in, Column out, no Python in the hot path."""
