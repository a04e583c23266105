"""Pure functions: types, text similarity, vocabulary."""
