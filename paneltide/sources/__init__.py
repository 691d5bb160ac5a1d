"""Sources of paneltide."""
