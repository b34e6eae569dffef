"""Operations for large text collections: scoring, tokenising, mixing, filtering and near-duplicates."""
