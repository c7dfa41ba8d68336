"""Training-data operators: mixing, quality rules, dedup, chat formatting, WARC, language ID, token counts, decontamination."""
