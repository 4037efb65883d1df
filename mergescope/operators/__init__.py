"""DataFrame operators: filters, joins, aggregates, quantiles, tests, sampling, overlap and parsing."""
