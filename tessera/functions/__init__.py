"""Column expressions: object ids, shards, locations and checksums."""
