"""Part of strandline: operators."""
