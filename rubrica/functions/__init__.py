"""Part of rubrica; see the README for its modules."""
