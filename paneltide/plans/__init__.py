"""Plans of paneltide."""
