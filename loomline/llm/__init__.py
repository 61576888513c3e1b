"""Training-data operators: ten corpus operations built as Spark jobs."""
