"""The operators as an agent's tools: requests and answers are JSON-RPC 2.0, a string each; how they travel is the caller's matter.

Every answer is a list of at most ``limit`` rows, as the operators order them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import cognition, lookup, metrics
from .plans import traverse

#: Rows of an answer, if the request names no other number, and at most.
ROWS, MOST_ROWS = 50, 1_000
PROTOCOL = "2024-11-05"


def _one(df: DataFrame, node_id: str) -> DataFrame:
    return df.filter(F.col("id") == node_id)


class Server:
    """Tools over one graph: nodes and edges."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, name: str = "skein") -> None:
        self.nodes, self.edges, self.name = nodes, edges, name
        start = lambda a: _one(nodes, a["id"]).select("id")
        paths = lambda a, **k: traverse.typed_paths(nodes, edges, start(a), max_paths=_limit(a), **k)
        entity = lambda a: lookup.entities_of_table(nodes, a["table"]).select("id")
        back = lambda a: traverse.typed_paths(nodes, edges, entity(a), direction="backward", target=F.col("entry_point"), max_paths=_limit(a))
        #: By name: what it answers, the arguments it needs, and the rows.
        self.tools: dict[str, tuple[str, tuple[str, ...], Callable[[dict], DataFrame]]] = {
            "node": ("a node by id", ("id",), lambda a: lookup.ensure_exists(nodes, a["id"])),
            "search": ("nodes by a part of their names", ("text",), lambda a: lookup.search(nodes, a["text"], a.get("kind"), _limit(a))),
            "callees": ("what a node calls", ("id",), lambda a: lookup.neighbours(edges, start(a)).select(F.col("neighbour").alias("id")).orderBy("id")),
            "callers": ("what calls a node", ("id",), lambda a: lookup.neighbours(edges, start(a), "backward").select(F.col("neighbour").alias("id")).orderBy("id")),
            "call_chains": ("call chains from a node", ("id",), lambda a: paths(a, max_depth=int(a.get("depth", 3))).select("path_id", "length")),
            "entry_points": ("entries that reach a node", ("id",), lambda a: traverse.entry_points(edges, start(a)).select(F.col("entry").alias("id")).orderBy("id")),
            "reach": ("what a node reaches", ("id",), lambda a: traverse.closure(edges, start(a), max_hops=int(a.get("depth", 5)), most=MOST_ROWS).select("id", "distance").orderBy("distance", "id")),
            "impact": ("what a change of a node may break", ("id",), lambda a: cognition.downstream(edges, nodes, start(a)).orderBy(F.desc("risk"), "id")),
            "table_impact": ("paths from entries to a table", ("table",), lambda a: back(a).select("path_id", "length", "root", "leaf")),
            "entities_by_table": ("entities of a table", ("table",), lambda a: lookup.entities_of_table(nodes, a["table"], bool(a.get("prefix")))),
            "entities_by_class": ("entities of a class", ("name",), lambda a: lookup.entities_of_class(nodes, a["name"])),
            "stats": ("nodes by kind", (), lambda a: lookup.stats(nodes).orderBy("kind")),
            "subsystems": ("projects and what is in them", (), lambda a: cognition.subsystems(nodes).orderBy("project_name")),
            "layers": ("nodes by layer", (), lambda a: cognition.layers(nodes).orderBy("layer")),
            "integration_points": ("pairs of projects that call each other", (), lambda a: cognition.integration_points(nodes, edges, _limit(a))),
            "capabilities": ("services and their calls", (), lambda a: cognition.capabilities(nodes, edges, _limit(a))),
            "root_causes": ("nodes that a failure may start from", ("text",), lambda a: cognition.root_cause_targets(nodes, a["text"].split(), _limit(a))),
            "route": ("which of these tools a question is for", ("text",), lambda a: cognition.route(nodes.sparkSession.createDataFrame([(0, a["text"])], "item_id int, text string"), nodes)),
            "degrees": ("callers and callees of a node", ("id",), lambda a: _one(metrics.degrees(nodes, edges), a["id"])),
        }

    def answer(self, name: str, arguments: dict) -> list[dict]:
        """The rows of a tool."""
        if name not in self.tools:
            raise LookupError(f"no tool {name}")
        _, needed, run = self.tools[name]
        if lost := [n for n in needed if not isinstance(arguments.get(n), str)]:
            raise ValueError(f"{name} needs {', '.join(lost)}")
        return [json.loads(x) for x in run(arguments).limit(_limit(arguments)).toJSON().collect()]

    def handle(self, request: str) -> str | None:
        """The answer to a request; none to a notification."""
        try:
            asked = json.loads(request)
        except json.JSONDecodeError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}})
        if not isinstance(asked, dict) or "method" not in asked:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}})
        if "id" not in asked:
            return None
        done = {"jsonrpc": "2.0", "id": asked["id"]}
        try:
            return json.dumps(done | {"result": self._result(asked["method"], asked.get("params") or {})}, ensure_ascii=False)
        except NotImplementedError:
            return json.dumps(done | {"error": {"code": -32601, "message": f"no method {asked['method']}"}})
        except (LookupError, ValueError) as e:
            return json.dumps(done | {"error": {"code": -32602, "message": str(e)}})

    def _result(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            shape = lambda needed: {"type": "object", "properties": {n: {"type": "string"} for n in needed}, "required": list(needed)}
            return {"tools": [{"name": n, "description": d, "inputSchema": shape(needed)} for n, (d, needed, _) in sorted(self.tools.items())]}
        if method == "tools/call":
            rows = self.answer(params.get("name", ""), params.get("arguments") or {})
            return {"content": [{"type": "text", "text": json.dumps(rows, ensure_ascii=False)}], "isError": False}
        raise NotImplementedError


def _limit(arguments: dict) -> int:
    return max(1, min(int(arguments.get("limit", ROWS)), MOST_ROWS))
