"""streaming of authorloom."""
