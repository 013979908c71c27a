"""Column functions: time, text, addresses, payloads."""
