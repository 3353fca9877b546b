"""Graph encoder inference in numpy, one graph at a time, over Arrow batches."""
