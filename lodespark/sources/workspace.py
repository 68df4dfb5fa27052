"""A workspace: the tables of an index as Parquet below one folder, and exports of its graph."""

from __future__ import annotations

import uuid
from xml.sax.saxutils import escape, quoteattr

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark import schemas
from lodespark.config import EngineConfig
from lodespark.functions import models
from lodespark.functions import text as T
from lodespark.operators import index
from lodespark.session import cut


class Workspace:
    """The tables of ``schemas.WORKSPACE``. A missing table is empty; a broken one raises.

    Tables are written in batches, each into folders of its own, and a batch counts once its one commit row stands in
    ``commits``. A run that breaks off before leaves nothing that is read, and a batch of a name that is committed
    already is not added again. A commit may also drop what tables held before, so that a reset and a fresh index are
    one step.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, schema: str, *paths: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).parquet(*paths)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or len(paths) > 1 or not paths[0].endswith("/commits"):
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> list[tuple[int, str, list[str], list[str]]]:
        """The committed batches in order: one row per run; ``compact`` makes one of them."""
        return sorted(tuple(r) for r in self._read(schemas.COMMIT, f"{self.path}/commits").distinct().collect())

    def table(self, name: str) -> DataFrame:
        held: list[str] = []
        for _, batch, tables, dropped in self.commits():
            held = [*([] if name in dropped else held), *([batch] if name in tables else [])]
        return self._read(schemas.WORKSPACE[name], *[f"{self.path}/batches/{batch}/{name}" for batch in held])

    def commit(self, tables: dict[str, DataFrame], batch: str | None = None, drop: tuple[str, ...] = ()) -> bool:
        """Writes tables as one batch; false if a batch of this name is committed already."""
        known = self.commits()
        batch = batch or uuid.uuid4().hex
        if any(b == batch for _, b, *_ in known):
            return False
        for name, rows in tables.items():
            columns = [f.split()[0] for f in schemas.WORKSPACE[name].split(", ")]
            rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}/{name}")
        row = (max((c[0] for c in known), default=0) + 1, batch, sorted(tables), sorted(drop))
        self.spark.createDataFrame([row], schemas.COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def index(self, docs: DataFrame, config: EngineConfig, force: bool = False, key: str = "doc_id", text: str = "text", embedder: models.Embedder | None = None, extractor: models.Extractor | None = None, batch: str | None = None) -> tuple[int, int]:
        """Adds new and changed documents with their vectors, as one batch; returns how many traces and chunks.

        ``force`` starts from nothing. Without an embedder no vectors are stored.
        """
        parts = index.index_documents(docs, None if force else self.table("manifest"), config, key, text, extractor=extractor)
        chunks = cut(parts["chunks"])
        traces = cut(index.traces_of(chunks, extractor))
        tables = {"chunks": chunks, "traces": traces, "edges": index.graph_edges(traces), "manifest": parts["manifest"]}
        if embedder is not None:
            tables["trace_vectors"] = index.vectors_of(traces, "id", T.entity_text(F.col("entity_text"), F.col("entity_description")), embedder, 0 if force else self.next_id("trace_vectors"))
            tables["chunk_vectors"] = index.vectors_of(chunks, "chunk_id", F.col("chunk_text"), embedder, 0 if force else self.next_id("chunk_vectors"))
        added = self.commit(tables, batch, tuple(schemas.WORKSPACE) if force else ())
        return (traces.count(), chunks.count()) if added else (0, 0)

    def index_chunks(self, docs: DataFrame, config: EngineConfig, force: bool = False, key: str = "doc_id", text: str = "text", embedder: models.Embedder | None = None, batch: str | None = None) -> tuple[int, int]:
        """Adds chunks only, by the recursive splitter, of documents whose id is new; the first number is always 0.

        ``force`` indexes all documents given afresh, in place of what they had.
        """
        parts = index.index_documents(docs, None if force else self.table("manifest"), config, key, text, "recursive", by_content=False)
        chunks = cut(parts["chunks"])
        tables = {"chunks": chunks, "manifest": parts["manifest"]}
        drop: tuple[str, ...] = ()
        first = self.next_id("chunk_vectors")
        if force:
            given = docs.select(F.col(key).cast("string").alias("source_doc_id")).distinct()
            kept = self.table("chunks").join(given, "source_doc_id", "left_anti")
            tables["manifest"] = self.table("manifest").join(given, F.col("doc_id") == F.col("source_doc_id"), "left_anti").unionByName(parts["manifest"])
            tables["chunks"], drop = kept.unionByName(chunks), ("chunks", "manifest", "chunk_vectors")
        if embedder is not None:
            fresh = index.vectors_of(chunks, "chunk_id", F.col("chunk_text"), embedder, first)
            tables["chunk_vectors"] = index.lookup(self.table("chunk_vectors"), kept.select(F.col("chunk_id").alias("id"))).unionByName(fresh) if force else fresh
        return (0, chunks.count()) if self.commit(tables, batch, drop) else (0, 0)

    def next_id(self, name: str) -> int:
        last = self.table(name).agg(F.max("vec_id")).first()[0]
        return 0 if last is None else last + 1

    def vectors(self, name: str, dimension: int) -> DataFrame:
        """Stored vectors; vectors of another dimension are an error."""
        return self.table(name).withColumn("embedding", index.checked(F.col("embedding"), dimension))

    def reset(self, *names: str) -> None:
        """Empties the tables named, all without names, in one step."""
        self.commit({}, drop=names or tuple(schemas.WORKSPACE))

    def compact(self) -> None:
        """Writes every table anew as one batch."""
        held = [name for name in schemas.WORKSPACE if any(name in tables for *_, tables, _ in self.commits())]
        self.commit({name: self.table(name) for name in held}, drop=tuple(schemas.WORKSPACE))

    def current_traces(self) -> DataFrame:
        """Traces with what the logs tell: status, number of accesses and time of the last one."""
        used = self.table("accesses").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_accessed_at"))
        # An id has few changes of its status; of equal times the greater status counts.
        told = self.table("activations").groupBy("id").agg(F.max(F.struct("at", "status"))["status"].alias("now"))
        rows = self.table("traces").join(used, "id", "left").join(told, "id", "left")
        return rows.withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).withColumn("status", F.coalesce("now", "status")).drop("n", "now")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return index.graph_nodes(self.table("traces"), self.table("chunks")), self.table("edges")

    def export_graph_json(self, path: str) -> None:
        """Nodes and edges as JSON lines in two folders; a missing type becomes 'unknown'."""
        nodes, edges = self.graph()
        nodes.withColumn("type", F.coalesce("type", F.lit("unknown"))).write.mode("overwrite").json(f"{path}/nodes")
        edges.withColumn("type", F.coalesce("type", F.lit("unknown"))).write.mode("overwrite").json(f"{path}/edges")

    def export_graph(self, path: str, form: str = "json") -> None:
        """The whole graph as one document, ``json`` or ``graphml``, in part files that follow one another by name."""
        nodes, edges = self.graph()
        (graph_json if form == "json" else graphml)(nodes, edges).write.mode("overwrite").text(path)


def _document(head: str, sections: list[tuple[DataFrame, str]], foot: str, separator: str) -> DataFrame:
    """One text column, in order over the partitions: head, the elements of each section and what follows it, foot.

    ``sections`` give rows of (key, element); within a section, elements after the first begin with ``separator``.
    """
    spark = sections[0][0].sparkSession
    rows = spark.createDataFrame([(0, "", head)], "part int, key string, value string")
    for n, (elements, after) in enumerate(sections):
        first = elements.agg(F.min(F.struct("key", "element")).alias("m"))
        # One row: its size is fixed.
        led = elements.join(F.broadcast(first), F.lit(True), "left")
        text = F.when(F.struct("key", "element") == F.col("m"), F.col("element")).otherwise(F.concat(F.lit(separator), F.col("element")))
        rows = rows.unionByName(led.select(F.lit(2 * n + 1).alias("part"), "key", text.alias("value")))
        rows = rows.unionByName(spark.createDataFrame([(2 * n + 2, "", after)], "part int, key string, value string"))
    rows = rows.unionByName(spark.createDataFrame([(2 * len(sections) + 1, "", foot)], "part int, key string, value string"))
    ordered = rows.withColumn("led", F.when(F.col("value").startswith(separator), 1).otherwise(0) if separator else F.lit(0))
    return ordered.repartitionByRange("part", "key", "led").sortWithinPartitions("part", "key", "led").select("value")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as one JSON object: nodes (id, type, text, metadata) and edges (source, target, type, metadata)."""
    kind = F.coalesce("type", F.lit("unknown")).alias("type")
    metadata = F.from_json(F.coalesce(F.col("metadata"), F.lit("{}")), "map<string,string>").alias("metadata")
    node = nodes.dropDuplicates(["id"]).select(F.col("id").alias("key"), F.to_json(F.struct("id", kind, F.coalesce("text", F.lit("")).alias("text"), metadata)).alias("element"))
    none = F.create_map().cast("map<string,string>").alias("metadata")
    edge = edges.distinct().select(F.concat_ws("|", "source", "target").alias("key"), F.to_json(F.struct("source", "target", kind, none)).alias("element"))
    return _document('{"nodes": [', [(node, '], "edges": ['), (edge, "")], "]}", ",")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as one GraphML document with declared keys."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    head += "".join(f'<key id="{k}" for="{e}" attr.name="{k}" attr.type="string"/>\n' for k, e in (("type", "node"), ("text", "node"), ("relation", "edge"))) + '<graph edgedefault="directed">'
    node = graphml_rows(nodes.dropDuplicates(["id"]), edges.limit(0)).select(F.col("element").alias("key"), "element")
    edge = graphml_rows(nodes.limit(0), edges.distinct()).select(F.col("element").alias("key"), "element")
    return _document(head, [(node, ""), (edge, "")], "</graph>\n</graphml>", "")


def _xml(text: Column) -> Column:
    """Text without the control characters that XML cannot hold."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements of nodes and edges, one per row; ``graphml`` makes a document of them."""

    @F.pandas_udf("string")
    def node(ids, kinds, texts):
        return ids.combine(kinds, lambda i, k: f"<node id={quoteattr(i or '')}><data key=\"type\">{escape(k or 'unknown')}</data>").str.cat(texts.map(lambda t: f'<data key="text">{escape(t or "")}</data></node>'))

    @F.pandas_udf("string")
    def edge(sources, targets, kinds):
        ends = sources.combine(targets, lambda s, t: f"<edge source={quoteattr(s or '')} target={quoteattr(t or '')}>")
        return ends.str.cat(kinds.map(lambda k: f'<data key="relation">{escape(k or "unknown")}</data></edge>'))

    return nodes.select(node(_xml(F.col("id")), _xml(F.col("type")), _xml(F.col("text"))).alias("element")).unionByName(edges.select(edge(_xml(F.col("source")), _xml(F.col("target")), _xml(F.col("type"))).alias("element")))
