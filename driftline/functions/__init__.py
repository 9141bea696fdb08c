"""Part of Driftline."""
