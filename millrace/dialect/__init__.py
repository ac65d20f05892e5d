"""Text to syntax tree; no Spark here."""
