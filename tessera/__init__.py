"""Tessera: semantic retrieval, knowledge organisation and corpus preparation on Spark."""
