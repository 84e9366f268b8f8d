"""MySQL statements as text."""
