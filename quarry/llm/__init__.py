"""Operations of a training-data pipeline: scoring, sharding, joins, mixing, tokens, media, extraction, search."""
