"""End-to-end flows (studies, ML stages, models, scoring) and the query catalog."""
