"""Training-data operators: packing, chat formatting, mixing, dedup, filters, extraction, sharding, fingerprints."""
