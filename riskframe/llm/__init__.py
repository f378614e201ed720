"""Training-data operators (decontamination, extraction, deduplication,
packing, formatting, toxicity, sharding, token files). Nothing outside this
subpackage imports it."""
