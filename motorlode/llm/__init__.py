"""Training-data operators: dedup, filtering, extraction, mixing and tokenising at corpus scale."""
