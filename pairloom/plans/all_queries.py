"""Importing this module fills the registry."""

from pairloom.plans import clean_queries, entity_queries, json_queries, lifecycle_queries, preference_queries, prep_queries, rollout_queries, stream_queries, transcript_queries  # noqa: F401
