"""Training-data operators: cleaning, deduplication, mixing and output of text corpora."""
