"""Operators for preparing training data: names, conversations, pieces, encodings, privacy, tokens, mixing, look-alikes."""
