"""Incremental forms of rollout and log metrics, over file-source streams."""
