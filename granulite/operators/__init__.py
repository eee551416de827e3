"""Operators: each takes DataFrames and returns a DataFrame; none runs an action,
except the blob labelling in ``segment`` which loops until no label changes."""
