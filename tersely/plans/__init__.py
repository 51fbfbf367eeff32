"""plans of the text-redundancy engine."""
