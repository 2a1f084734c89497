"""Column functions: paths, fuzzy scores, relevance, categories, codecs."""
