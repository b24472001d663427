"""Tables and page archives."""
