"""operators of the text-redundancy engine."""
