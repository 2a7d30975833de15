"""Reading and writing cubes."""
