"""Relational operators: panels, calendars, joins, aggregates, selection, events, search, models."""
