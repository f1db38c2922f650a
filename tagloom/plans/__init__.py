"""The labelling run: model calls in waves and everything around them."""
