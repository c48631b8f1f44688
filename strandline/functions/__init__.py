"""Part of strandline: functions."""
