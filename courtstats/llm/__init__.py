"""Training-data operators (toxicity, dedup, language ID, mixing, secrets,
LM scoring, decontamination).  Nothing else in the library imports this
subpackage; ``queries`` holds the registered queries."""
