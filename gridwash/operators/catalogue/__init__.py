"""The named cleaning operations, by family."""
