"""Training-data operators: quality rules, host reputation, main-text
extraction, decontamination, near-duplicate join, source mixing, token files,
WARC archive, toxicity scores and token counts."""
