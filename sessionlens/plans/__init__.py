"""Physical-plan helpers that keep hot groups spread over many tasks."""
