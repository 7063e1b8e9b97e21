"""Every operator as a query over the given tables, with the same result in DuckDB SQL where SQL can say it."""
