"""Operations of a training-data pipeline: sharding, scoring, language, packing, search, deduplication, mixing, toxicity, media."""
