"""Queries over the driver's tables, each with its SQL. Geometry is derived from keys."""
