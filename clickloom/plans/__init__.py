"""Named reports assembled from operators."""
