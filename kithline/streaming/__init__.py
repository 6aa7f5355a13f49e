"""The batch operators as streams."""
