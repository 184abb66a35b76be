"""Reading meshes and fields from tables, and writing and reloading them."""
