"""DataFrame operators: tables in, table out, nothing collected."""
