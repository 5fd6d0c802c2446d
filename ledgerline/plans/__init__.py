"""Plans built from the operators: the sports-match model, its layers, and the standard tables."""
