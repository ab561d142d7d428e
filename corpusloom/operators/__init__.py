"""DataFrame operators: aggregates, windows, joins, graphs, selection, rules, metrics."""
