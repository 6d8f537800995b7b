"""Training-data operators: one module per operator, none imported by the rest of the library."""
