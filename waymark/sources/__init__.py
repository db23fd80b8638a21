"""Sources and sinks of street graphs."""
