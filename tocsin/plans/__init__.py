"""Part of tocsin: plans."""
