"""DuckDB oracle SQL for the registered queries (test tooling)."""
