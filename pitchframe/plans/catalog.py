"""All queries of the engine's own operators with their SQL."""

from __future__ import annotations

from pitchframe.plans import chain_queries, pass_queries, threat_queries, track_queries

PARTS = [threat_queries.registry, chain_queries.registry, pass_queries.registry, track_queries.registry]
QUERIES = {name: run for part in PARTS for name, run in part.queries.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.sql.items()}
FLAGSHIP = "xt_leaderboard"
