"""Types, aggregates and number formats of the dialect."""
