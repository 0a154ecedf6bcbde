from . import align, graph, monitor, relational, templates, transforms, upserts

__all__ = ["align", "graph", "monitor", "relational", "templates", "transforms", "upserts"]
