from plainsight.workloads import evaluation, flows, graph, quality, scoring, sources, text  # noqa: F401
from plainsight.workloads.registry import REGISTRY

__all__ = ["REGISTRY"]
