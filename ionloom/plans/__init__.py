"""Ready-made questions over the given tables, with SQL statements of the same meaning."""
