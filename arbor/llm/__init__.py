"""Operations of a training-data pipeline: scoring, scanning, searching, packing, media."""
