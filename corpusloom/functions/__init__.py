"""Column functions: text, fingerprints, privacy, flags, extraction."""
