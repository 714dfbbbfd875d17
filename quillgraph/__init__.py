"""quillgraph: a Spark-native engine for provenance-aware text stores."""
