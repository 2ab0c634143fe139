"""Fitted models and embeddings. A model is a small table or matrix; pixels stay distributed."""
