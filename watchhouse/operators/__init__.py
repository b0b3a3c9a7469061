"""Relational operators: normalisation, enrichment, filters, joins, maintenance."""
