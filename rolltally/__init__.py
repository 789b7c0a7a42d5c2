"""Spark operators for the data work around language-model post-training."""
