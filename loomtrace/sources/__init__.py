"""Files, SQLite stores and configuration."""
