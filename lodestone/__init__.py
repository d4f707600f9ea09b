"""lodestone: corpus curation, evaluation statistics and round bookkeeping on PySpark."""
