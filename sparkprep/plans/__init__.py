"""Multi-step compositions: ingest (J3), preprocess (J4), model training (M9...)."""
