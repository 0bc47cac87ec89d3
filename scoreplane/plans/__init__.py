"""End-to-end plans over the shared test tables, the query registry and oracle SQL."""
