"""Named reports (``reports``) and the registered queries with their DuckDB
oracle SQL (``registry`` collects ``*_queries`` modules)."""
