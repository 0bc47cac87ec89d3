"""Training-data operators: dedup, filters, mixing, language, formatting, PII, classifiers, decontamination.

Nothing else in the library imports this subpackage."""
