"""Training-data operators: one module each, DataFrame in and DataFrame out."""
