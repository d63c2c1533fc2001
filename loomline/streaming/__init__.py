"""streaming of loomline."""
