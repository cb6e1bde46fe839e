"""Column expressions: vectors and the similarity kernel, names and formats, pixels, and the feature registry."""
