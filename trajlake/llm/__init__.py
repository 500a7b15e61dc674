"""Operations of a training-data pipeline: one module an operator, queries in ``queries``."""
