"""Operators for preparing training corpora: sharding, mixing, deduplication, language, quality and links."""
