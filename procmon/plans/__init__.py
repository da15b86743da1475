"""Registered queries: each pairs a Spark job with the DuckDB SQL that states its result."""
