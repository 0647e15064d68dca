"""Training-data operators. Nothing else in barloom imports this subpackage."""
