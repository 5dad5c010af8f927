"""Part of tocsin: sources."""
