"""The registered queries, by family."""

from . import code, evaluation, graph, metrics, sources, state, text, understanding  # noqa: F401
