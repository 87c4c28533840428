"""Column functions: identities, sequences, barcodes, run-length programs."""
