"""Queries over whole-program facts (symbols, call edges, pointer constraints, traces) as Spark jobs."""
