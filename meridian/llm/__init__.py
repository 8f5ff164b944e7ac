"""Training-data operators: ten DataFrame-to-DataFrame stages for text corpora."""
