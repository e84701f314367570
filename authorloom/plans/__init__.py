"""plans of authorloom."""
