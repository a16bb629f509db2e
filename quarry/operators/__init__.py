"""Index, ranking, completion, sketches and codecs."""
