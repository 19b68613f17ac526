"""DataFrame -> DataFrame operators (reshape, filters, joins, metrics)."""
