"""sources of authorloom."""
