"""DataFrame operators: selection, dedup, manifest, cleaning, assignment, numbering, bundles."""
