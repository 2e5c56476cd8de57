"""Operations for large training-data pipelines, one module for each."""
