"""Column functions: paths, globs, sizes, languages and scalar encodings."""
