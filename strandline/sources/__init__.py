"""Part of strandline: sources."""
