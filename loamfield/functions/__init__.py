"""Part of the loamfield engine."""
