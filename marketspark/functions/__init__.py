"""Column and frame helpers shared by every operator."""
