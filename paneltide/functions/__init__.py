"""Functions of paneltide."""
