"""Quillstone: decision-corpus analytics expressed as Spark DataFrame plans."""
