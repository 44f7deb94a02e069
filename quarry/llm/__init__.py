"""Training-data operators: fingerprints, near-duplicate and substring removal,
language and quality models, chat formatting, packing, decontamination,
pseudonyms and token storage. Nothing else in the library imports this package."""
