"""sources of the text-redundancy engine."""
