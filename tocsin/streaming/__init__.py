"""Part of tocsin: streaming."""
