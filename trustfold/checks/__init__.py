"""Every operator as a named query over the given tables, with SQL to compare against."""
