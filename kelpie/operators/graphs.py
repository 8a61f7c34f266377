"""Pipeline graphs and the knowledge graph as relations (M25..M38, X13, X14, S13, M27..M31).

nodes: (graph, node, label, ...); edges: (graph, src, dst, ...)."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.sources.tables import durable


def parse_triples(lines: DataFrame, predicates: list[str], col: str = "value") -> DataFrame:
    """(subject, predicate, object) of text lines; the longest predicate that fits is taken; other lines and comments are dropped."""
    import re

    alt = "|".join(re.escape(p) for p in sorted(predicates, key=lambda p: (-len(p), p)))
    pattern = rf"^\s*(.+?)\s+({alt})\s+(.+?)\s*$"
    part = lambda i: F.regexp_extract(col, pattern, i)
    rows = lines.where(~F.col(col).rlike(r"^\s*#"))
    return rows.select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object")).where("predicate <> ''")


def ancestors(edges: DataFrame, child: str, parent: str, depth: int = 32) -> DataFrame:
    """(node, ancestor, distance) up to `depth` steps, the shortest of each pair; a cycle ends where nothing new is reached."""
    one = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    step = one.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    found = durable(one.withColumn("distance", F.lit(1)))
    last = found
    for d in range(2, depth + 1):
        nxt = last.join(step, F.col("ancestor") == F.col("_n")).select("node", F.col("_a").alias("ancestor")).distinct()
        last = durable(nxt.join(found, ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(d)))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def per_graph(nodes: DataFrame, edges: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f(nodes [(node, label)], edges [(src, dst)]) -> rows (node, ...), once per graph. A graph is one document, so it fits a task;
    graphs are brought together by one exchange, whatever their depth."""
    label = F.col("label") if "label" in nodes.columns else F.lit("")
    n = nodes.groupBy("graph").agg(F.collect_list(F.struct(F.col("node").alias("a"), F.coalesce(label, F.lit("")).alias("b"))).alias("ns"))
    e = edges.where("src is not null and dst is not null").groupBy("graph").agg(F.collect_list(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))).alias("es"))

    def pairs(col: pa.ListArray) -> Iterator[list[tuple]]:
        flat, at = col.flatten(), 0
        both = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
        for n in col.value_lengths().fill_null(0).to_pylist():
            yield both[at : at + n]
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            graphs, rows = [], []
            for g, ns, es in zip(b.column(0).to_pylist(), pairs(b.column(1)), pairs(b.column(2))):
                got = f(ns, es)
                graphs += [g] * len(got)
                rows += got
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(graphs, b.column(0).type), *[pa.array(c) for c in zip(*rows)]] if any(r[1] is not None for r in rows) else [pa.array(graphs, b.column(0).type), pa.array([r[0] for r in rows]), pa.array([None] * len(rows), pa.int32())], names).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = dict(nodes.dtypes)["graph"]
    spark_schema = StructType.fromDDL(f"graph {kind}, {schema}")
    arrow, names = to_arrow_schema(spark_schema), spark_schema.names
    return n.join(e, "graph", "left").mapInArrow(run, spark_schema)


def level_rows(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    """(node, level) of one graph, in topological order; None for nodes on or behind a cycle."""
    names = list(dict.fromkeys(n for n, _ in nodes))
    known, into, out = set(names), dict.fromkeys(names, 0), defaultdict(list)
    for a, b in set(edges):
        if a in known and b in known:
            into[b] += 1
            out[a].append(b)
    level, ready = dict.fromkeys(names), [n for n in names if not into[n]]
    for n in ready:
        level[n] = 0
    done = []
    while ready:
        nxt = []
        for n in ready:
            done.append((n, level[n]))
            for m in out[n]:
                into[m] -= 1
                if not into[m]:
                    level[m] = level[n] + 1
                    nxt.append(m)
        ready = nxt
    return done + [(n, None) for n in names if level[n] is None]


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, level): the longest path that leads to a node; nodes on or behind a cycle have no level (null).

    Edges to nodes that are not there, repeated edges and null ends don't count."""
    return per_graph(nodes.select("graph", "node").where("node is not null"), edges, level_rows, "node string, level int")


def cyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs that hold a cycle."""
    return levels(nodes, edges).where("level is null").select("graph").distinct()


def flow_rows(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    """(node, problem) of one graph: `cycle` (on or behind one), `unreachable_from_source`, `unreachable_to_sink`. A node's label
    holds O for an operator, P for a parameter and K for the sink; flow starts at operators and parameters that nothing leads to."""
    label = dict(nodes)
    out, into = defaultdict(list), defaultdict(list)
    for a, b in set(edges):
        if a in label and b in label:
            out[a].append(b)
            into[b].append(a)

    def reached(start: list, step: dict) -> set:
        seen, todo = set(start), list(start)
        while todo:
            for m in step[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    rows = [(n, "cycle") for n, level in level_rows(nodes, edges) if level is None]
    ahead = reached([n for n, k in label.items() if ("O" in k or "P" in k) and not into[n]], out)
    rows += [(n, "unreachable_from_source") for n, k in label.items() if "O" in k and n not in ahead]
    sinks = [n for n, k in label.items() if "K" in k]
    if sinks:
        back = reached(sinks, into)
        rows += [(n, "unreachable_to_sink") for n, k in label.items() if "O" in k and n not in back]
    return rows


#: The columns of a signature registry; null types, roles and splits fit everything.
REGISTRY = "operator string, port string, direction string, place int, type string, role string, split string, required boolean, variadic boolean"


def validate(nodes: DataFrame, edges: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(graph, problem, item), every problem of every graph.

    nodes: graph, node and, if known, class_type (Operator, Parameter, ...), label (an operator's name), sink BOOLEAN. edges: graph, src,
    dst, position (the input port; null binds none) and, with a registry, output (a port's name or its place).
    dangling_edge (an end that is no node), duplicate_port (more than one edge at an input that isn't variadic), cycle,
    unreachable_from_source, unreachable_to_sink (if a sink is told) and, against the registry, unknown_operator,
    unknown_port, unwired_input (a required one) and type_mismatch (of type, role or split; `any` fits every type, a
    Prediction an Array). Null ids don't count; empty tables give an empty result."""
    col = lambda c, kind: F.col(c).cast(kind) if c in nodes.columns else F.lit(None).cast(kind)
    operator = F.when(col("class_type", "string") == "Operator", col("label", "string"))
    sort = F.concat(F.when(operator.isNotNull(), "O").otherwise(""), F.when(col("class_type", "string") == "Parameter", "P").otherwise(""), F.when(F.coalesce(col("sink", "boolean"), F.lit(False)), "K").otherwise(""))
    n = durable(nodes.where("node is not null").select("graph", "node", operator.alias("operator"), sort.alias("label")).distinct())
    e = durable(edges.select("graph", "src", "dst", "position", F.col("output").cast("string") if "output" in edges.columns else F.lit(None).cast("string").alias("output")))
    say = lambda d, what, item: d.select("graph", F.lit(what).alias("problem"), item.alias("item"))
    ends = e.select("graph", F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    found = say(ends.join(n, ["graph", "node"], "left_anti"), "dangling_edge", F.col("node"))
    found = found.unionByName(per_graph(n, e, flow_rows, "node string, problem string").select("graph", "problem", F.col("node").alias("item")))
    ops = n.where("operator is not null").select("graph", "node", "operator")
    at = e.where("position is not null and dst is not null").join(ops.withColumnRenamed("node", "dst"), ["graph", "dst"], "left")
    spot = F.concat_ws(":", "dst", "position")
    twice = at.groupBy("graph", "dst", "position", "operator").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if registry is None:
        return found.unionByName(say(twice, "duplicate_port", spot))
    reg = durable(registry)
    known = reg.select("operator").distinct()
    inputs = reg.where("direction = 'in'").select("operator", F.col("port").alias("position"), F.col("type").alias("i_type"), F.col("role").alias("i_role"), F.col("split").alias("i_split"), "required", "variadic")
    many = inputs.where("variadic").select("operator", "position")
    found = found.unionByName(say(twice.join(many, ["operator", "position"], "left_anti"), "duplicate_port", spot))
    found = found.unionByName(say(ops.join(known, "operator", "left_anti"), "unknown_operator", F.concat_ws(":", "node", "operator")))
    sure = at.join(known, "operator", "left_semi")
    found = found.unionByName(say(sure.join(inputs, ["operator", "position"], "left_anti"), "unknown_port", spot))
    need = ops.join(inputs.where("required").select("operator", "position"), "operator")
    found = found.unionByName(say(need.join(at.select("graph", F.col("dst").alias("node"), "position"), ["graph", "node", "position"], "left_anti"), "unwired_input", F.concat_ws(":", "node", "position")))
    outs = reg.where("direction = 'out'").select(F.col("operator").alias("from"), F.explode(F.array_distinct(F.array(F.col("port"), F.col("place").cast("string")))).alias("output"), F.col("type").alias("o_type"), F.col("role").alias("o_role"), F.col("split").alias("o_split"))
    wire = sure.join(inputs, ["operator", "position"]).join(ops.select("graph", F.col("node").alias("src"), F.col("operator").alias("from")), ["graph", "src"]).join(outs, ["from", "output"])
    typed = (F.col("o_type") == F.col("i_type")) | (F.col("o_type") == "any") | (F.col("i_type") == "any") | ((F.col("o_type") == "Prediction") & (F.col("i_type") == "Array"))
    wrong = F.concat_ws(",", F.when(~typed, "type"), F.when(F.col("o_role") != F.col("i_role"), "role"), F.when(F.col("o_split") != F.col("i_split"), "split"))
    return found.unionByName(say(wire.where(wrong != ""), "type_mismatch", F.concat_ws(":", "src", "dst", "position", wrong)))


def match_pattern(nodes: DataFrame, edges: DataFrame, labels: list[str], links: list[tuple[int, int]]) -> DataFrame:
    """Injective matches of a small pattern: node i has a label that fits the regex labels[i], links are edges between them.

    One equi-join per link, on the graph and a node that is bound already."""
    fits = [nodes.where(F.col("label").rlike(p)).select("graph", F.col("node").alias(f"n{i}")) for i, p in enumerate(labels)]
    out, bound = fits[0], {0}
    pend = list(links)
    e = edges.select("graph", "src", "dst").distinct()
    while pend:
        link = next((x for x in pend if x[0] in bound or x[1] in bound), None)
        if link is None:
            raise ValueError("the pattern is not connected")
        pend.remove(link)
        a, b = link
        step = e.select("graph", F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{b}"))
        for i in link:
            if i not in bound:
                step = step.join(fits[i], ["graph", f"n{i}"], "left_semi")
        out = out.join(step, ["graph", *[f"n{i}" for i in dict.fromkeys(link) if i in bound]])
        bound |= {a, b}
    for i in range(len(labels)):
        for j in range(i):
            if i in bound and j in bound:
                out = out.where(F.col(f"n{i}") != F.col(f"n{j}"))
    return out.select("graph", *[f"n{i}" for i in sorted(bound)]).distinct()


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, reroute: bool = True) -> tuple[DataFrame, DataFrame]:
    """Take out nodes (graph, node) and their edges; `reroute` links each one's predecessors with its successors."""
    keep = nodes.join(gone, ["graph", "node"], "left_anti")
    src, dst = gone.withColumnRenamed("node", "src"), gone.withColumnRenamed("node", "dst")
    e = edges.select("graph", "src", "dst")
    out = e.join(src, ["graph", "src"], "left_anti").join(dst, ["graph", "dst"], "left_anti")
    if reroute:
        before = e.join(dst, ["graph", "dst"], "left_semi").select("graph", "src", F.col("dst").alias("mid"))
        after = e.join(src, ["graph", "src"], "left_semi").select("graph", F.col("src").alias("mid"), "dst")
        out = out.unionByName(before.join(after, ["graph", "mid"]).select("graph", "src", "dst").join(src, ["graph", "src"], "left_anti").join(dst, ["graph", "dst"], "left_anti")).distinct()
    return keep, out


def rewrite(nodes: DataFrame, edges: DataFrame, match: Callable, steps: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """One application of a rule to all graphs at once: `match`(nodes, edges) gives the nodes (graph, node) it applies to; then the steps
    are taken in order, each for what was matched:

    ("add", suffix, label, where): a node named after the matched one with the suffix; where: `after` or `before` links it behind or ahead, `between` puts it on all edges that leave.
    ("delete", reroute): the matched nodes go; with reroute their predecessors are linked with their successors.
    ("relabel", label), ("reroute", suffix): edges that lead to a matched node lead to the one with the suffix.
    ("apply", f): f(nodes, edges, matched) -> (nodes, edges). ("replace",): a graph with a match becomes empty."""
    n, e = nodes.select("graph", "node", "label"), edges.select("graph", "src", "dst")
    hit = durable(match(n, e).select("graph", "node").distinct())
    for kind, *args in steps:
        if kind == "add":
            suffix, label, where = args
            new = hit.select("graph", F.col("node").alias("at"), F.concat("node", F.lit(suffix)).alias("node"))
            n = n.unionByName(new.select("graph", "node", F.lit(label).alias("label")))
            if where == "between":
                moved = e.join(hit.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi").select("graph", F.concat("src", F.lit(suffix)).alias("src"), "dst")
                e = e.join(hit.withColumnRenamed("node", "src"), ["graph", "src"], "left_anti").unionByName(moved)
            src, dst = ("at", "node") if where in ("after", "between") else ("node", "at")
            e = e.unionByName(new.select("graph", F.col(src).alias("src"), F.col(dst).alias("dst")))
        elif kind == "delete":
            n, e = delete_nodes(n, e, hit, *args)
        elif kind == "relabel":
            n = n.join(hit.withColumn("_hit", F.lit(True)), ["graph", "node"], "left").select("graph", "node", F.when(F.col("_hit"), F.lit(args[0])).otherwise(F.col("label")).alias("label"))
        elif kind == "reroute":
            to = hit.select("graph", F.col("node").alias("dst"), F.concat("node", F.lit(args[0])).alias("_to"))
            e = e.join(to, ["graph", "dst"], "left").select("graph", "src", F.coalesce("_to", "dst").alias("dst"))
        elif kind == "apply":
            n, e = args[0](n, e, hit)
        elif kind == "replace":
            n, e = (x.join(hit.select("graph").distinct(), "graph", "left_anti") for x in (n, e))
        else:
            raise NotImplementedError(f"unknown step {kind}")
    return n.select("graph", "node", "label"), e.select("graph", "src", "dst")


def fixpoint(state: tuple[DataFrame, DataFrame], rule: Callable, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """Apply `rule` (nodes, edges) -> (nodes, edges) until the number of nodes and edges stays, at most `most` times."""
    size = (state[0].count(), state[1].count())
    for _ in range(most):
        state = tuple(map(durable, rule(*state)))
        new = (state[0].count(), state[1].count())
        if new == size:
            break
        size = new
    return state


def class_hash(nodes: DataFrame, edges: DataFrame, value: str | None = None) -> DataFrame:
    """(graph, hash) of the sorted labels, the sorted label pairs of edges and (X14) the values; node ids don't count."""
    cols = [F.col("label")] + ([F.coalesce(value, F.lit(""))] if value else [])
    n = nodes.groupBy("graph").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", *cols))), ",").alias("ns"))
    name = nodes.select("graph", "node", "label")
    pairs = edges.join(name.select("graph", F.col("node").alias("src"), F.col("label").alias("sl")), ["graph", "src"]).join(name.select("graph", F.col("node").alias("dst"), F.col("label").alias("dl")), ["graph", "dst"])
    e = pairs.groupBy("graph").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "sl", "dl"))), ",").alias("es"))
    return n.join(e, "graph", "left").select("graph", F.sha2(F.concat_ws(";", "ns", F.coalesce("es", F.lit(""))), 256).alias("hash"))


def key_rows(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    """(node, key) of one graph: the hash of a node's label and of its predecessors' keys; nodes on or behind a cycle have none."""
    import hashlib

    label, back = dict(nodes), defaultdict(set)
    for a, b in edges:
        if a in label:
            back[b].add(a)
    keys: dict = {}
    for n, level in level_rows(nodes, edges):
        if level is not None:
            up = ",".join(sorted(keys[p] for p in back[n]))
            keys[n] = hashlib.sha256(f"{label[n]}|{up}".encode()).hexdigest()
    return list(keys.items())


def reuse_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, key): the content address of every node: equal keys mean equal work, in whichever graph."""
    return per_graph(nodes.where("node is not null"), edges, key_rows, "node string, key string")


def match_exceptions(instances: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, tier, pattern): by equal hash, else by regex within equal type and library, else by type and library prefix, else miss.

    instances: id, hash, type, library, message. patterns: pattern, phash, ptype, plibrary, regex; a curated list, of which the
    best (least name) of a tier is taken."""
    a = instances.join(patterns.select("phash", F.col("pattern").alias("p1")).groupBy("phash").agg(F.min("p1").alias("p1")), F.col("hash") == F.col("phash"), "left").drop("phash")
    leaf = patterns.where("regex is not null").select("ptype", "plibrary", "regex", F.col("pattern").alias("p2"))
    b = a.join(leaf, (F.col("type") == F.col("ptype")) & (F.col("library") == F.col("plibrary")) & F.expr("message rlike regex"), "left")
    b = b.groupBy(*instances.columns, "p1").agg(F.min("p2").alias("p2"))
    bucket = patterns.groupBy("ptype", F.split("plibrary", r"\.")[0].alias("prefix")).agg(F.min("pattern").alias("p3"))
    c = b.join(bucket, (F.col("type") == F.col("ptype")) & (F.split("library", r"\.")[0] == F.col("prefix")), "left")
    tier = F.when(F.col("p1").isNotNull(), "hash").when(F.col("p2").isNotNull(), "leaf").when(F.col("p3").isNotNull(), "bucket").otherwise("miss")
    return c.select("id", tier.alias("tier"), F.coalesce("p1", "p2", "p3").alias("pattern"))


def lcs(a: list[str], b: list[str]) -> list[str]:
    """The longest common subsequence of two token lists; what they share at both ends is set aside first."""
    few = min(len(a), len(b))
    pre = next((i for i in range(few) if a[i] != b[i]), few)
    post = next((i for i in range(few - pre) if a[-1 - i] != b[-1 - i]), few - pre)
    head, tail, a, b = a[:pre], a[len(a) - post :], a[pre : len(a) - post], b[pre : len(b) - post]
    rows = [array("i", bytes(4 * (len(b) + 1))) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = 1 + rows[i + 1][j + 1] if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return head + out + tail


def template(samples: list[str], wild: str = "<*>") -> str | None:
    """The tokens that all samples share, with a wildcard for what varies between; None for fewer than two samples."""
    if len(samples) < 2:
        return None
    words = [s.split() for s in sorted(samples)]
    keep = words[0]
    for w in words[1:]:
        keep = lcs(keep, w)
    out, at = [], [0] * len(words)
    for k in keep:
        gap = False
        for i, w in enumerate(words):
            j = w.index(k, at[i])
            gap |= j > at[i]
            at[i] = j + 1
        out += [wild, k] if gap else [k]
    if any(a < len(w) for a, w in zip(at, words)):
        out.append(wild)
    return " ".join(out)


def mine_templates(df: DataFrame, bucket: str, message: str, samples: int = 32) -> DataFrame:
    """(bucket, template, n_samples) of the first 32 distinct messages of every bucket; buckets with one message have none."""
    distinct = df.where(F.col(bucket).isNotNull() & F.col(message).isNotNull()).select(F.col(bucket).cast("string").alias("bucket"), F.col(message).alias("message")).distinct()
    w = Window.partitionBy("bucket").orderBy("message")
    few = distinct.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples).groupBy("bucket").agg(F.collect_list("message").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, t, len(m)) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (t := template(m))]
            if rows:
                k, t, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(n, pa.int32())], ["bucket", "template", "n_samples"])

    return few.mapInArrow(run, "bucket string, template string, n_samples int")


def action_mask(candidates: DataFrame, used: DataFrame, task: str, caps: dict[str, int]) -> DataFrame:
    """Operators that may come next: of the task, not used yet, and of a family whose cap isn't reached.

    candidates: operator, task, family; used: operator, family of the graph so far (a bounded list)."""
    n = used.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    limit = F.lit(None).cast("int")
    for f, c in caps.items():
        limit = F.when(F.col("family") == f, c).otherwise(limit)
    out = candidates.where(F.col("task") == task).join(used.select("operator"), "operator", "left_anti").join(F.broadcast(n), "family", "left")
    return out.where(limit.isNull() | (F.coalesce("n", F.lit(0)) < limit)).select("operator", "task", "family")


def valid_actions(candidates: DataFrame, used: DataFrame, free: list[str], task: str, max_estimators: int = 1, max_transformers: int = 5) -> DataFrame:
    """The candidates that may be added to a graph next.

    candidates: operator, task (null: any), family, interface (estimator, transformer or other), inputs ARRAY<STRUCT<type, required>>
    (a null type fits all). used: operator, family, interface of the graph so far, a bounded list. free: the types of its free outputs.
    Out go: operators in use, those of another task, transformers behind an estimator, estimators and transformers over their cap,
    estimators of a family in use, those with a required input that no free output fits, and those with inputs of which none fits."""
    has = used.agg(F.coalesce(F.count_if(F.col("interface") == "estimator"), F.lit(0)).alias("_e"), F.coalesce(F.count_if(F.col("interface") == "transformer"), F.lit(0)).alias("_t"))
    families = used.where("family is not null").select("family").distinct().withColumn("_taken", F.lit(True))
    out = candidates.join(F.broadcast(used.select("operator").distinct()), "operator", "left_anti")  # the graph so far is a bounded list
    out = out.where(F.col("task").isNull() | (F.col("task") == task)).crossJoin(F.broadcast(has)).join(F.broadcast(families), "family", "left")  # one row; bounded
    estimator, transformer = F.coalesce(F.col("interface") == "estimator", F.lit(False)), F.coalesce(F.col("interface") == "transformer", F.lit(False))
    ok = ~(transformer & (F.col("_e") > 0)) & ~(estimator & (F.col("_e") >= max_estimators)) & ~(transformer & (F.col("_t") >= max_transformers)) & ~(estimator & F.coalesce("_taken", F.lit(False)))
    fits = lambda x: x["type"].isNull() | (x["type"].isin(*free) if free else F.lit(False))
    ins = F.coalesce("inputs", F.array().cast(candidates.schema["inputs"].dataType))
    ok = ok & F.forall(ins, lambda x: ~F.coalesce(x["required"], F.lit(False)) | fits(x)) & ((F.size(ins) == 0) | F.exists(ins, fits))
    return out.where(ok).select(*candidates.columns)


def topological_order(edges: list[tuple[str, str]], nodes: list[str]) -> list[str] | None:
    """M27 on one graph, on the driver: an order (ties by name), or None if there is a cycle."""
    import heapq

    into, out = defaultdict(int), defaultdict(list)
    for a, b in set(edges):
        into[b] += 1
        out[a].append(b)
    ready, done = [n for n in nodes if not into[n]], []
    heapq.heapify(ready)
    while ready:
        n = heapq.heappop(ready)
        done.append(n)
        for m in out[n]:
            into[m] -= 1
            if not into[m]:
                heapq.heappush(ready, m)
    return done if len(done) == len(nodes) else None
