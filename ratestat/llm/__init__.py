"""Training-data operators: quality, language, toxicity and language-model
scores, rule cascades, deduplication, decontamination, token counts and
sequence packing over large document tables."""
