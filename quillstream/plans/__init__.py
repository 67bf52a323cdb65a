"""Queries: operators applied to the adapter relations, each with independent DuckDB SQL."""
