"""SQL statements that compute the registered queries on the same tables."""
