"""functions of authorloom."""
