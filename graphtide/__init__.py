"""graphtide: a PySpark library that builds, queries and improves a knowledge graph of scored triples."""
