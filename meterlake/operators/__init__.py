"""Part of meterlake."""
