"""Named queries, the semantic layer and multi-step jobs."""
