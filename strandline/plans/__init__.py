"""Part of strandline: plans."""
