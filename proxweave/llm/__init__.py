"""Training-data operators: sharding, de-duplication, privacy, quality, token counts, scoring, extraction."""
