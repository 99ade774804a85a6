"""The registered queries, each beside the DuckDB SQL that says the same."""
