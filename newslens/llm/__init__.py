"""Operators for training data at scale: private data, fingerprints, duplicates, secrets, leaks, chats, packing and toxicity."""
