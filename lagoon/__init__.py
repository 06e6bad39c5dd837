"""Point-in-time analytics on Spark: lazy DataFrame operators for panels, events, text and vectors."""
