"""DataFrame -> DataFrame operators (filters, joins, ranks, aggregates, sequences)."""
