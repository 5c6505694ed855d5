"""Jobs that give context to DNS and browser-history events, on Spark."""
