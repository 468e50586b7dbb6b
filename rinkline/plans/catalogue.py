"""All queries of the core, by name, and their SQL."""

from rinkline.plans import content, events, games, models, pages, people, staging, texts, trainingdata, writing

FLAGSHIP = "timeline_cumulative_points"
_MODULES = (games, staging, events, people, content, models, pages, texts, writing, trainingdata)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
