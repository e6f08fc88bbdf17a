"""Training-data operators on text tables. Nothing outside this subpackage imports it."""
