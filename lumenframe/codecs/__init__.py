"""Frame codecs, a registry of them, and the column functions that run them over frames."""
