"""Table registry, stage files and role mapping."""
