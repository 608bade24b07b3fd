"""Registered queries of the core, each with its DuckDB SQL where SQL can express it."""
