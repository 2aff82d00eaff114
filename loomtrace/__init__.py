"""Agent session logs as Spark tables: sources, sessions, search, edits and statistics."""
