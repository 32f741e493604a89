"""Where relations and model files come from."""
