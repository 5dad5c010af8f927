"""Part of tocsin: functions."""
