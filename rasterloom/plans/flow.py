"""Flows: JSON graphs of stages, checked before any job, run as lazy plans with content-named checkpoints."""

from __future__ import annotations

import hashlib
import json
import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FlowError, ParamError
from ..operators.pixels import Cube
from .stages import REGISTRY, Features, Labels

VERSION = 2  # 1 may leave parameters out
ALIASES = {"export_h5": "export"}


@dataclass
class Node:
    id: str
    type: str
    params: dict = field(default_factory=dict)


@dataclass
class Graph:
    nodes: list[Node]
    edges: list[tuple[str, str, str, str]]  # from node, port, to node, port
    version: int = VERSION
    name: str = ""

    @classmethod
    def read(cls, text: str) -> Graph:
        """A flow from JSON; an end of an edge is ``{"node", "port"}`` or ``"node.port"``. A text without version is of version 1."""

        def end(x) -> tuple[str, str]:
            node, port = (x["node"], x["port"]) if isinstance(x, dict) else x.split(".")
            return node, port

        try:
            raw = json.loads(text)
            edges = [(*end(e["from"]), *end(e["to"])) for e in raw.get("edges", [])]
            nodes = [Node(n["id"], ALIASES.get(n["type"], n["type"]), dict(n.get("params", {}))) for n in raw["nodes"]]
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise FlowError(f"not a flow: {e!r}") from e
        return cls(nodes, edges, raw.get("version", 1), raw.get("name", ""))

    def text(self) -> str:
        edges = [{"id": f"e{i}", "from": {"node": a, "port": p}, "to": {"node": b, "port": q}} for i, (a, p, b, q) in enumerate(self.edges, 1)]
        return json.dumps({"version": self.version, "name": self.name, "nodes": [vars(n) for n in self.nodes], "edges": edges}, indent=1)

    def into(self, node: str) -> dict[str, tuple[str, str]]:
        return {q: (a, p) for a, p, b, q in self.edges if b == node}


@dataclass(frozen=True)
class Issue:
    kind: str  # error or warning
    where: str
    text: str


def order(graph: Graph) -> list[str]:
    """Topological order, first come first served; shorter than the nodes where there is a cycle."""
    waits = {n.id: {a for a, _, b, _ in graph.edges if b == n.id} for n in graph.nodes}
    ready, out = deque(n.id for n in graph.nodes if not waits[n.id]), []
    while ready:
        out.append(at := ready.popleft())
        for n in graph.nodes:
            if at in waits[n.id]:
                waits[n.id].discard(at)
                if not waits[n.id]:
                    ready.append(n.id)
    return out


def validate(graph: Graph) -> list[Issue]:
    found: list[Issue] = []
    err = lambda where, text: found.append(Issue("error", where, text))
    if graph.version not in (1, VERSION):
        err("flow", f"version {graph.version} is neither 1 nor {VERSION}")
    seen: dict[str, Node] = {}
    for n in graph.nodes:
        if n.id in seen:
            err(n.id, "the id is used twice")
        seen[n.id] = n
        if n.type not in REGISTRY:
            err(n.id, f"there is no stage {n.type!r}")
            continue
        s = REGISTRY[n.type]
        for k in s.params:
            if k not in n.params and graph.version > 1:
                err(n.id, f"parameter {k!r} is missing")
        try:
            s.check(s.coerced(n.params))
        except ParamError as e:
            err(n.id, str(e))
    used, fed = set(), {}
    for a, p, b, q in graph.edges:
        if a not in seen or b not in seen or seen[a].type not in REGISTRY or seen[b].type not in REGISTRY:
            if a not in seen or b not in seen:
                err(f"{a}.{p}", f"the edge to {b}.{q} has an unknown end")
            continue
        given, wanted = REGISTRY[seen[a].type].outputs.get(p), REGISTRY[seen[b].type].inputs.get(q)
        if given is None:
            err(f"{a}.{p}", "there is no such output")
        elif wanted is None:
            err(f"{b}.{q}", "there is no such input")
        elif given != wanted.rstrip("?"):
            err(f"{b}.{q}", f"takes {wanted.rstrip('?')}, not {given}")
        used.add((a, p))
        fed[b, q] = fed.get((b, q), 0) + 1
    for n in seen.values():
        if n.type not in REGISTRY:
            continue
        for q, tag in REGISTRY[n.type].inputs.items():
            times = fed.get((n.id, q), 0)
            if times > 1 or times == 0 and not tag.endswith("?"):
                err(f"{n.id}.{q}", "several edges lead here" if times else "no edge leads here")
        found += [Issue("warning", f"{n.id}.{p}", "nothing takes this output") for p in REGISTRY[n.type].outputs if (n.id, p) not in used]
    if len(order(graph)) < len(seen):
        err("flow", "there is a cycle")
    return found


def complete(graph: Graph) -> Graph:
    """Every parameter written out, in canonical types."""
    return Graph([Node(n.id, n.type, REGISTRY[n.type].coerced(n.params)) for n in graph.nodes], list(graph.edges), VERSION, graph.name)


def lineage(graph: Graph, at: str) -> dict[str, int]:
    """The nodes that ``at`` is computed from, and itself, with the least number of edges between."""
    found, ready = {at: 0}, deque([at])
    while ready:
        n = ready.popleft()
        for up, _ in graph.into(n).values():
            if up not in found:
                found[up] = found[n] + 1
                ready.append(up)
    return found


def override(graph: Graph, settings: list[str]) -> Graph:
    """``node.param=value`` settings, values as JSON where they parse."""
    nodes = {n.id: Node(n.id, n.type, dict(n.params)) for n in graph.nodes}
    for s in settings:
        key, eq, value = s.partition("=")
        node, dot, param = key.partition(".")
        if not eq or not dot or node not in nodes or param not in REGISTRY[nodes[node].type].params:
            raise FlowError(f"{s!r} is not node.param=value of this flow")
        try:
            nodes[node].params[param] = json.loads(value)
        except ValueError:
            nodes[node].params[param] = value
    return Graph(list(nodes.values()), list(graph.edges), graph.version, graph.name)


def recipes(graph: Graph, sources: dict[str, str] | None = None) -> dict[str, str]:
    """A name for what each node computes: the hash of its type, parameters, inputs' recipes and source files."""
    by, out = {n.id: n for n in graph.nodes}, {}
    for at in order(graph):
        up = {q: [out[a], p] for q, (a, p) in sorted(graph.into(at).items())}
        text = json.dumps({"type": by[at].type, "params": by[at].params, "upstream": up, "source": (sources or {}).get(at)}, sort_keys=True, separators=(",", ":"))
        out[at] = hashlib.sha256(text.encode()).hexdigest()[:32]
    return out


def source_signature(spark: SparkSession, folder: str, glob: str) -> str:
    """Path, size and time of every matching file, without reading contents."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime").orderBy("path").collect()
    return ";".join(f"{r.path.rsplit('/', 1)[-1]}:{r.length}:{r.modificationTime.timestamp()}" for r in rows)


def filled(params: dict, tokens: dict[str, str]) -> dict:
    """{input}, {out}, {work} and last {flow} in string parameters."""
    out = dict(params)
    for token in ("input", "out", "work", "flow"):
        if token in tokens:
            out = {k: v.replace("{" + token + "}", tokens[token]) if isinstance(v, str) else v for k, v in out.items()}
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _held(spark: SparkSession, value, path: str | None):
    """The payload read from its checkpoint, written first where there is none; without a path as it is."""
    df = getattr(value, "df", value)
    if path is None or not isinstance(df, DataFrame):
        return value
    if not _exists(spark, path):
        df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    if isinstance(value, Cube):
        return value.of(df)
    if isinstance(value, Labels):
        return Labels(df, value.space, value.names, value.history)
    return Features(df, value.explained) if isinstance(value, Features) else df


def run(spark: SparkSession, graph: Graph, tokens: dict[str, str] | None = None, work: str | None = None, provided: dict[str, dict] | None = None, skip_sinks: bool = False, on_event=lambda name, **facts: None) -> dict:
    """Validates, then applies stages in order; returns each node's outputs and a record of the run.

    Plans stay lazy: jobs run only where a stage needs a statistic, in sinks, and, with
    ``work``, to write each payload under its recipe, from which later runs read it.
    ``provided`` gives outputs of nodes that are not to be run.
    """
    errors = [i for i in validate(graph) if i.kind == "error"]
    if errors:
        raise FlowError("; ".join(f"{i.where}: {i.text}" for i in errors))
    graph, tokens = complete(graph), {**(tokens or {}), "flow": graph.text()}
    nodes, outputs, record = {n.id: n for n in graph.nodes}, {}, []
    sources = [n for n in graph.nodes if REGISTRY[n.type].source and n.id not in (provided or {})]
    try:
        names = recipes(graph, {n.id: source_signature(spark, filled(n.params, tokens)["input_dir"], n.params["file_glob"]) for n in sources})
    except PySparkException as e:
        raise FlowError(f"no source files: {e}") from e
    for at in order(graph):
        s, began = REGISTRY[nodes[at].type], time.time()
        if skip_sinks and s.sink:
            continue
        on_event("started", node=at, stage=s.name)
        try:
            if provided and at in provided:
                got = provided[at]
            else:
                inputs = {q: outputs[a][p] for q, (a, p) in graph.into(at).items()}
                got = s.run(spark, inputs, filled(nodes[at].params, tokens))
            outputs[at] = {p: _held(spark, v, f"{work}/{names[at]}-{p}" if work else None) for p, v in got.items()}
        except Exception as e:
            on_event("failed", node=at, error=str(e))
            raise FlowError(f"{at} ({s.name}): {e}") from e
        record.append({"node": at, "stage": s.name, "recipe": names[at], "seconds": time.time() - began, "status": "ok"})
        on_event("finished", node=at, seconds=record[-1]["seconds"])
    return {"outputs": outputs, "record": record}


def schema() -> dict:
    """JSON schema of flows, one variant of node for each stage."""
    kinds = {"int": "integer", "float": "number", "bool": "boolean", "str": "string", "enum": "string"}

    def one(p):
        t = kinds[p.kind] if not (p.choices and isinstance(p.choices[0], int)) else "integer"
        out = {"type": [t, "null"] if p.template is None else t, "default": p.template}
        return {**out, **({"enum": list(p.choices)} if p.choices else {}), **({"minimum": p.least} if p.least is not None else {}), **({"maximum": p.most} if p.most is not None else {})}

    variants = [{"type": "object", "required": ["id", "type", "params"], "properties": {"id": {"type": "string"}, "type": {"const": s.name}, "params": {"type": "object", "additionalProperties": False, "required": sorted(s.params), "properties": {k: one(p) for k, p in s.params.items()}}}} for s in REGISTRY.values()]
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["nodes"], "properties": {"version": {"enum": [1, VERSION]}, "name": {"type": "string"}, "nodes": {"type": "array", "items": {"oneOf": variants}}, "edges": {"type": "array"}}}


def builtin(name: str) -> Graph:
    """``stepwise``, ``global``, ``tiled`` or ``tiled-rare``, built from one chain."""
    if name not in ("stepwise", "global", "tiled", "tiled-rare"):
        raise FlowError(f"there is no flow {name!r}")
    tiled, rare, sinks = name.startswith("tiled"), name == "tiled-rare", name != "stepwise"
    kinds = {"src": "load_elements", "msk": "mask", "dn": "denoise", "nrm": "normalize", "pca": "pca", "hdb": "hdbscan_tiled" if tiled else "hdbscan_global", **({"rare": "rare_phase"} if rare else {}), "knn": "noise_assign", "stats": "cluster_stats", "fp": "fingerprints"}
    raw = "rare" if rare else "hdb"
    wires = ["msk.cube<src.cube", "dn.cube<src.cube", "dn.masks<msk.masks", "nrm.cube<dn.cube", "nrm.masks<msk.masks", "pca.cube<nrm.cube", "pca.masks<msk.masks", "hdb.features<pca.features", f"knn.labels<{raw}.labels", "knn.features<pca.features", "stats.labels<knn.labels", "fp.labels<knn.labels", "fp.cube<dn.cube"]
    wires += ["hdb.cube<dn.cube"] * tiled + ["rare.labels<hdb.labels", "rare.features<pca.features", "rare.cube<dn.cube", "rare.tiles<hdb.tiles"] * rare
    if sinks:
        kinds |= {"exp": "export", "q_mask": "qc_mask", "q_dn": "qc_denoise", "q_nrm": "qc_normalize", "q_scree": "qc_scree", "q_map": "qc_phase_map", "q_sum": "qc_cluster_summary", "q_fp": "qc_fingerprints", **({"q_tiled": "qc_tiled"} if tiled else {})}
        wires += ["exp.cube_raw<src.cube", "exp.bse<src.bse", "exp.masks<msk.masks", "exp.cube_denoised<dn.cube", "exp.cube_normalized<nrm.cube", "exp.features<pca.features", f"exp.labels_raw<{raw}.labels", "exp.labels<knn.labels", "exp.stats<stats.stats"]
        wires += ["q_mask.bse<src.bse", "q_mask.masks<msk.masks", "q_dn.cube_raw<src.cube", "q_dn.cube_denoised<dn.cube", "q_dn.bse<src.bse", "q_dn.masks<msk.masks", "q_nrm.cube<nrm.cube", "q_nrm.masks<msk.masks", "q_scree.features<pca.features", f"q_map.labels_raw<{raw}.labels", "q_map.labels<knn.labels", "q_map.bse<src.bse", "q_map.stats<stats.stats", "q_sum.stats<stats.stats", "q_fp.fingerprints<fp.fingerprints"]
        wires += [f"exp.tiles<{raw}.tiles", "q_tiled.bse<src.bse", f"q_tiled.tiles<{raw}.tiles", "q_tiled.features<pca.features"] * tiled
    edges = []
    for w in wires:
        to, _, frm = w.partition("<")
        edges.append((*frm.split("."), *to.split(".")))
    return Graph([Node(k, v, REGISTRY[v].template()) for k, v in kinds.items()], edges, VERSION, name)


def run_catalogue_flow(spark: SparkSession, cube: Cube, tiled: bool) -> DataFrame:
    """Final labels of a builtin flow over a cube that stands in for the loaded images."""
    small = ["msk.min_object_size=0", "hdb.min_cluster_size=100", "hdb.min_samples=25"] + ["hdb.tile_size=32", "hdb.min_clusters_per_tile=2", "rare.min_samples=15"] * tiled
    graph = override(builtin("tiled-rare" if tiled else "stepwise"), small)
    bse = cube.df.select("row", "col", F.col(f"`{cube.channels[0]}`").alias("bse"))
    got = run(spark, graph, provided={"src": {"cube": cube, "bse": bse}}, skip_sinks=True)
    return got["outputs"]["knn"]["labels"].df.select("pixel_id", "row", "col", "label")
