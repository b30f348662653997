"""Column functions and the registries that name them."""
