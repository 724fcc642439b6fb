"""Evidence, note-corpus and trajectory analytics expressed as Spark DataFrame plans."""
