"""Curation, tokenizer, evaluation and report operators."""
