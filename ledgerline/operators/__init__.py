"""DataFrame operators, parameterised by columns."""
