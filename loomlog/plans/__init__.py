"""Plans: bounded operations on texts."""
