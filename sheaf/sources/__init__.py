"""Sources: files and tables as a corpus."""
