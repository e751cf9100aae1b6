"""Change feeds and subscriptions."""
