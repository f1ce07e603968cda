"""Training-data operators: token counts, encoding, PII, near and substring dedup, language,
secrets, quality and decontamination.  Nothing else in the library imports this subpackage."""
