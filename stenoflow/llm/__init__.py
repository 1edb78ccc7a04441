"""Operators for preparing training text: language, turns, personal data, splitting, characters, tokens, packing, truncation."""
