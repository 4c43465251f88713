"""Training-data operators: packing, decontamination, search, language models, stores, scans and deduplication."""
