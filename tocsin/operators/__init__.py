"""Part of tocsin: operators."""
