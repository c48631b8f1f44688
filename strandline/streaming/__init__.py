"""Part of strandline: streaming."""
