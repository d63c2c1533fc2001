"""sources of loomline."""
