"""Operators for training-data pipelines: near-duplicates, decontamination, tokens, chats, classifiers, packing."""
