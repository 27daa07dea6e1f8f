"""Operations of a training-data pipeline: quality, language, duplicates, contamination, tokens and formats."""
