"""Operations of a large-scale training-data pipeline (text corpora on Spark)."""
