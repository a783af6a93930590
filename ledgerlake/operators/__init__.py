"""Reusable DataFrame operators: scopes, security, joins, ranking, ordered state, checks."""
