"""Table-agnostic relational operators: DataFrame in, DataFrame out."""
