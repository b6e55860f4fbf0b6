"""SQL front end and the query registry."""
