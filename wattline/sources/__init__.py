"""Table derivation, file scans, landing and sinks."""
