"""Plans: relations described once, run by Spark and checked by DuckDB."""
