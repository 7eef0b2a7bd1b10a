"""All queries of the engine and their SQL."""

from __future__ import annotations

from surfacelab.plans import meshes, points, records, search, surfaces, topology, unwrap

QUERIES = {**points.QUERIES, **meshes.QUERIES, **records.QUERIES, **search.QUERIES, **unwrap.QUERIES, **topology.QUERIES, **surfaces.QUERIES}
SQL = {**points.SQL, **meshes.SQL, **records.SQL, **unwrap.SQL, **topology.SQL, **surfaces.SQL}
