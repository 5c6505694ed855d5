"""Reading events, lists and rules."""
