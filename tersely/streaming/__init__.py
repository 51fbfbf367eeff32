"""streaming of the text-redundancy engine."""
