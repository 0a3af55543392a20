"""Training-data operators: personal data, secrets, toxicity, tokens, quality, archives,
decontamination, URL rules, binary-code search and n-gram similarity joins.

Nothing outside this subpackage imports it.
"""
