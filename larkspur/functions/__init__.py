"""Column functions: codecs of the scalar types, row text and hashes."""
