"""operators of authorloom."""
