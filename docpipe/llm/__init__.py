"""Training-data operators: ten corpus operators, their queries and the corpus pipeline's stages."""
