"""A PySpark-native engine that builds, packs, mixes and evaluates speech-and-text training corpora."""
