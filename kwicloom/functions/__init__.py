"""Column functions: regular-expression dialect, ranking, association measures."""
