"""End-to-end flows: lazy compositions of the operators, one per analysis stage."""
