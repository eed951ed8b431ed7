"""Operators for large training-data corpora: hashing, language, media, shards, pieces, joins, privacy, mixing."""
