"""Training-data operators: ten large-corpus components, independent of the rest of the library."""
