"""Training-data operators: deduplication, decontamination, quality, language, tokens, mixing and chat formatting."""
