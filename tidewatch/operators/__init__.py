"""Series operators: DataFrame in, DataFrame out, lazily."""
