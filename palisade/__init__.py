"""Conversation-threat and data-leak analytics as plain Spark DataFrame jobs."""
