"""noticeloom: a PySpark engine for public-notice data, plus training-data operators in ``noticeloom.llm``."""
