"""Operators for training text: truncation, broken pairs, encoding, packing, look-alikes."""
