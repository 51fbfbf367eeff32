"""functions of the text-redundancy engine."""
