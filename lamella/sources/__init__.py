"""Sources and sinks of chunked arrays."""
