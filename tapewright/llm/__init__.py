"""Operations for training-data corpora, as Spark jobs."""
