"""Analysis of the work logs of many software projects at once, and preparation of training text, on Spark."""
