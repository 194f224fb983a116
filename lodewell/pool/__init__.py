"""Reading a pool: members, topology, blocks, objects, datasets, files."""
