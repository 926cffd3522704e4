"""Reading and writing: files, layers, streams and the stand-in for the raw lender files."""
