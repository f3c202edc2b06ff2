"""Questions, decision facts, dashboard queries and the batch pipeline."""
