"""Registered queries of the mesh operators, with DuckDB SQL of the same results."""

from mortar.queries import exchange, fields, mesh, plans, points

QUERIES = mesh.QUERIES | fields.QUERIES | points.QUERIES | plans.QUERIES | exchange.QUERIES
ORACLES = mesh.ORACLES | fields.ORACLES | points.ORACLES | plans.ORACLES | exchange.ORACLES
