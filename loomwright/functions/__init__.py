"""Part of the loomwright engine."""
