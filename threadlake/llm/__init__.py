"""Operations of a training-data pipeline: extraction, deduplication, cleaning, scoring and tokens."""
