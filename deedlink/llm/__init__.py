"""Operators for preparing training text: sharding, archives, near duplicates, quality, secrets, licences, tokens, leaks."""
