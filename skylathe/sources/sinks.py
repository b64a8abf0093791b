"""Tables, graphs, mapping sets, reports, provenance and catalogs written out.

Large results are written by the workers (CSV, N-Triples, TriG blocks, Parquet). Only what has a size bound of
its own - reports, caches, provenance records, catalogs, charts of some top rows - is formatted on the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import DC, RDF, XSD, datatype, iri, is_bnode, is_iri, literal, text
from ..session import cut, cut_count

#: Characters of the text of a graph that are hashed at a time.
BLOCK = 1 << 20
OWL = "http://www.w3.org/2002/07/owl#"
PROV = "http://www.w3.org/ns/prov#"
DCTERMS = "http://purl.org/dc/terms/"


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def ntriples(triples: DataFrame) -> DataFrame:
    """(line) of N-Triples."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


def trig_blocks(quads: DataFrame) -> DataFrame:
    """(block): one TriG block for each graph and subject; a subject's triples are bounded by its own degree."""
    per_p = quads.distinct().groupBy("g", "s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("o"))
    per_s = per_p.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n        ").alias("po"))
    return per_s.select(F.concat("g", F.lit(" {\n    "), "s", F.lit(" "), "po", F.lit(" .\n}")).alias("block"))


def write_trig(quads: DataFrame, path: str) -> None:
    trig_blocks(quads).write.mode("overwrite").text(path)


def _refine(t: DataFrame, nodes: DataFrame, kinds: int) -> tuple[DataFrame, int]:
    """Blank nodes' labels (b, h) told apart by their triples and neighbours until no round tells more apart."""
    while True:
        hs, ho = nodes.select(F.col("b").alias("s"), F.col("h").alias("hs")), nodes.select(F.col("b").alias("o"), F.col("h").alias("ho"))
        seen = t.join(hs, "s", "left").join(ho, "o", "left")
        out = seen.filter("hs is not null").select(F.col("s").alias("b"), F.concat_ws(" ", F.lit(">"), "p", F.coalesce("ho", "o")).alias("e"))
        back = seen.filter("ho is not null").select(F.col("o").alias("b"), F.concat_ws(" ", F.lit("<"), "p", F.coalesce("hs", "s")).alias("e"))
        around = out.unionByName(back).groupBy("b").agg(F.array_join(F.array_sort(F.collect_list("e")), "\n").alias("e"))
        nodes = cut(nodes.join(around, "b").select("b", F.sha2(F.concat_ws("\n", "h", "e"), 256).alias("h")))
        now = nodes.select("h").distinct().count()
        if now == kinds:
            return nodes, now
        kinds = now


def canonical_lines(triples: DataFrame) -> DataFrame:
    """(line): N-Triples with blank nodes named by their neighbourhood, so equal graphs give equal lines.

    A blank node's label is the hash of its triples, refined by the labels of its neighbours until no round tells
    more nodes apart. Of nodes still alike one in each connected group is marked, and refined again, until all nodes
    of a group differ; groups that are alike as wholes are numbered. No two nodes share a label, so no lines merge.
    Which of several alike nodes is marked makes no difference if they can be exchanged for each other; graphs with
    alike nodes that cannot (some regular graphs) may get lines that depend on their labels.
    """
    t = triples.select("s", "p", "o").distinct()
    blank = lambda c: F.startswith(c, F.lit("_:"))
    t, blanks = cut_count(t, "startswith(s, '_:') or startswith(o, '_:')")
    if not blanks:
        return ntriples(t)
    nodes = cut(t.select(F.explode(F.array("s", "o")).alias("b")).filter(blank("b")).distinct())
    n = nodes.count()
    nodes, kinds = _refine(t, nodes.withColumn("h", F.lit("")), 0)
    if kinds < n:
        links = t.filter(blank("s") & blank("o")).select("s", "o")
        both = links.unionByName(links.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()
        group, low = nodes.select("b", F.col("b").alias("g")), -1
        while True:  # the smallest label of each connected group
            near = both.join(group.select(F.col("b").alias("o"), "g"), "o").groupBy("s").agg(F.min("g").alias("g2"))
            moved = group.join(near.withColumnRenamed("s", "b"), "b", "left").select("b", F.least("g", "g2").alias("g"), (F.col("g2") < F.col("g")).alias("less"))
            moved = cut(moved)
            low = moved.filter("less").count()
            group = moved.select("b", "g")
            if not low:
                break
        while True:
            alike = nodes.join(group, "b").groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).filter("n > 1")
            marked = alike.groupBy("g").agg(F.min_by("b", "h").alias("b")).select("b", F.lit("!").alias("mark"))
            if not marked.limit(1).count():
                break
            nodes, kinds = _refine(t, nodes.join(marked, "b", "left").select("b", F.concat("h", F.coalesce("mark", F.lit(""))).alias("h")), 0)
        # groups alike as wholes are numbered
        wholes = nodes.join(group, "b").groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("whole"))
        numbered = wholes.withColumn("k", F.row_number().over(Window.partitionBy("whole").orderBy("g")))
        nodes = nodes.join(group, "b").join(numbered, "g").select("b", F.sha2(F.concat_ws("\n", "h", F.col("k").cast("string")), 256).alias("h"))
    name = lambda c: F.coalesce(F.concat(F.lit("_:c"), F.substring(f"h{c}", 1, 32)), F.col(c)).alias(c)
    hs, ho = nodes.select(F.col("b").alias("s"), F.col("h").alias("hs")), nodes.select(F.col("b").alias("o"), F.col("h").alias("ho"))
    return ntriples(t.join(hs, "s", "left").join(ho, "o", "left").select(name("s"), "p", name("o")))


def stable_text(triples: DataFrame) -> str:
    """Sorted canonical lines with a line end, for graphs of one question's size."""
    lines = sorted({r["line"] for r in canonical_lines(triples).collect()})
    return "\n".join(lines) + "\n" if lines else ""


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _blocks(batches: Iterator) -> Iterator:
    """(first, text) of sorted lines: texts of about ``BLOCK`` characters of different lines, with their first line."""
    import pyarrow as pa

    last, held, size = None, [], 0
    for b in batches:
        for line in b.column(0).to_pylist():
            if line == last:
                continue
            held.append(line)
            last, size = line, size + len(line) + 1
            if size >= BLOCK:
                yield pa.RecordBatch.from_pydict({"first": held[:1], "text": ["\n".join(held) + "\n"]})
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"first": held[:1], "text": ["\n".join(held) + "\n"]})


def _hash_of_texts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    h = hashlib.sha256()
    for b in batches:
        for text in b.column("text"):
            h.update(text.as_buffer())
    yield pa.RecordBatch.from_pydict({"hash": [h.hexdigest()]})


def stable_hash(triples: DataFrame) -> DataFrame:
    """(hash): one row, the ``text_hash`` of the ``stable_text`` of a graph of any size.

    The workers sort the lines and put them together to blocks, which are told apart and ordered by their first lines.
    A hash has to be taken in order, so one task reads the blocks, a batch at a time; the driver sees none of them.
    """
    blocks = canonical_lines(triples).orderBy("line").mapInArrow(_blocks, "first string, text string")
    none = triples.sparkSession.range(1).select(F.lit("").alias("first"), F.lit("").alias("text"))  # an empty graph has a hash too
    return blocks.unionByName(none).repartition(1).sortWithinPartitions("first").mapInArrow(_hash_of_texts, "hash string")


def file_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


# ---- mapping sets ----------------------------------------------------------------------------------------


def sssom_lines(rows: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """(line) of a mapping set in order: its metadata in comments, the header, the mappings."""
    spark = rows.sparkSession
    head = [*(f"#{k}: {v}" for k, v in metadata.items()), "\t".join(rows.columns)]
    top = spark.createDataFrame(list(enumerate(head)), "k int, line string").select(F.lit(0).alias("part"), "k", "line", *[F.lit(None).cast(t).alias(c) for c, t in _SSSOM_ORDER])
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[\t\n]", " "), F.lit(""))
    body = rows.select(F.lit(1).alias("part"), F.lit(0).alias("k"), F.concat_ws("\t", *map(cell, rows.columns)).alias("line"), *[F.col(c).cast(t) for c, t in _SSSOM_ORDER])
    return top.unionByName(body).orderBy("part", "k", "subject_id", F.desc("confidence"), "object_id").select("line")


_SSSOM_ORDER = (("subject_id", "string"), ("confidence", "double"), ("object_id", "string"))


def write_sssom(rows: DataFrame, path: str, metadata: dict[str, str], parts: int = 1) -> None:
    """A mapping set as TSV with its metadata in comments, written by the workers into the folder ``path``; the files
    in order of their names are the set. One file by default, as the format asks for."""
    lines = sssom_lines(rows, metadata)
    (lines.coalesce(1) if parts == 1 else lines).write.mode("overwrite").text(path)


def mapping_quads(rows: DataFrame, base: str, graph: str, timestamp: str) -> DataFrame:
    """(g, s, p, o) of a mapping set: each mapping, an axiom on it with its confidence, and the activity that made it."""
    full = lambda c: iri(F.concat(F.lit(base), F.regexp_replace(c, "^[^:]*:", "")))
    s, o = full(F.col("subject_id")), full(F.col("object_id"))
    pred = iri(F.regexp_replace("predicate_id", "^skos:", "http://www.w3.org/2004/02/skos/core#"))
    axiom = F.concat(F.lit("_:ax"), F.sha2(F.col("mapping_id"), 256))
    act = F.concat(F.lit("_:act"), F.sha2(F.col("mapping_id"), 256))
    p = lambda ns, n: F.lit(f"<{ns}{n}>")
    triples = [
        (s, pred, o),
        (axiom, p(RDF, "type"), p(OWL, "Axiom")), (axiom, p(OWL, "annotatedSource"), s), (axiom, p(OWL, "annotatedProperty"), pred), (axiom, p(OWL, "annotatedTarget"), o),
        (axiom, F.lit(f"<{base}confidence>"), literal(F.col("confidence").cast("string"), datatype=XSD + "double")),
        (axiom, p(PROV, "wasGeneratedBy"), act), (axiom, p(DCTERMS, "date"), literal(F.col("mapping_date"), datatype=XSD + "date")),
        (axiom, p(DCTERMS, "source"), literal(F.col("mapping_source"))), (axiom, p(DC, "description"), literal(F.col("mapping_notes"))),
        (act, p(RDF, "type"), p(PROV, "Activity")), (act, p(PROV, "endedAtTime"), literal(F.lit(timestamp), datatype=XSD + "dateTime")),
        (act, p(PROV, "wasAssociatedWith"), literal(F.col("mapping_tool"))), (act, p(PROV, "used"), literal(F.col("mapping_source_checksum"))),
    ]
    arr = F.array(*[F.struct(a.alias("s"), b.alias("p"), c.alias("o")) for a, b, c in triples])
    return rows.select(F.explode(arr).alias("t")).select(F.lit(f"<{graph}>").alias("g"), "t.*").dropna().distinct()


# ---- small documents -------------------------------------------------------------------------------------


def save_json(data: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def prov_record(step: str, inputs: list[str], outputs: list[str], started: datetime, ended: datetime, base: str, agent: str = "skylathe") -> dict:
    """A PROV record of one step: activity, what it used and made with checksums, and who ran it."""
    entity = lambda p: {"@id": p, "@type": "prov:Entity", "sha256": file_hash(p), "size": Path(p).stat().st_size} if Path(p).is_file() else {"@id": p, "@type": "prov:Entity"}
    run = f"{base}run/{step}/{started.astimezone(UTC):%Y%m%dT%H%M%S}"
    return {
        "@context": {"prov": PROV},
        "@graph": [
            {"@id": run, "@type": "prov:Activity", "prov:startedAtTime": started.isoformat(), "prov:endedAtTime": ended.isoformat(), "prov:wasAssociatedWith": agent, "prov:used": inputs},
            *[entity(p) for p in inputs],
            *[entity(p) | {"prov:wasGeneratedBy": run} for p in outputs],
            {"@id": agent, "@type": "prov:SoftwareAgent"},
        ],
    }


def up_to_date(record: dict, inputs: list[str], outputs: list[str]) -> bool:
    """Whether a step's outputs exist and its inputs are those of its record."""
    known = {e["@id"]: e.get("sha256") for e in record.get("@graph", []) if e.get("@type") == "prov:Entity"}
    return all(Path(p).exists() for p in outputs) and all(Path(p).is_file() and known.get(p) == file_hash(p) for p in inputs)


# Media types by suffix.
MEDIA_TYPES = {
    ".ttl": "text/turtle", ".trig": "application/trig", ".nt": "application/n-triples", ".nq": "application/n-quads", ".csv": "text/csv",
    ".tsv": "text/tab-separated-values", ".json": "application/json", ".jsonld": "application/ld+json", ".rdf": "application/rdf+xml", ".xml": "application/rdf+xml",
    ".rq": "application/sparql-query", ".sparql": "application/sparql-query",
}


def media_type(path: str) -> str:
    return MEDIA_TYPES.get(Path(path).suffix.lower(), "application/octet-stream")


def join_url(base: str, path: str) -> str:
    return path if re.match(r"https?://", path) else base.rstrip("/") + "/" + path.lstrip("/")


def data_catalog(files: list[str], base_url: str, name: str, licence: str | None = None, queries: list[str] | None = None) -> dict:
    """A schema.org catalog: a dataset with one download for each file, and queries as source code."""
    if not files:
        raise ValueError("no files")
    dataset = [
        {"@type": "Dataset", "name": Path(f).stem, "identifier": Path(f).stem,
         "distribution": [{"@type": "DataDownload", "encodingFormat": media_type(f), "contentUrl": join_url(base_url, f)}], **({"license": licence} if licence else {})}
        for f in files
    ]
    out = {"@context": "https://schema.org", "@type": "DataCatalog", "name": name, "url": base_url, "dataset": dataset}
    parts = [
        {"@type": "SoftwareSourceCode", "name": Path(q).stem.replace("_", " "), "programmingLanguage": "SPARQL", "encodingFormat": media_type(q), "contentUrl": join_url(base_url, q)}
        for q in queries or []
        if media_type(q) == "application/sparql-query"
    ]
    return out | ({"hasPart": parts} if parts else {})


def result_json(df: DataFrame) -> DataFrame:
    """(value): one JSON object for each solution, written by the workers."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def result_bindings(df: DataFrame) -> DataFrame:
    """(value): one binding of the JSON result form of SPARQL for each solution, given its encoded terms; unbound
    variables are left out."""

    def term(c: str):
        t = F.col(f"`{c}`")
        kind = F.when(is_iri(t), "uri").when(is_bnode(t), "bnode").otherwise("literal")
        lang = F.nullif(F.regexp_extract(t, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1), F.lit(""))
        value = F.when(is_bnode(t), F.substring(t, F.lit(3), F.length(t))).otherwise(text(t))
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), lang.alias("xml:lang"), F.regexp_extract(datatype(t), "<(.*)>", 1).alias("datatype"))).alias(c)

    return df.select(F.to_json(F.struct(*[term(c) for c in df.columns])).alias("value"))


def write_result(df: DataFrame, path: str) -> None:
    """Solutions in the JSON result form of SPARQL, written by the workers; the files in order of their names are the document."""
    spark = df.sparkSession
    head = json.dumps({"head": {"vars": df.columns}})[:-1] + ', "results": {"bindings": ['
    ends = spark.createDataFrame([(0, head), (2, "]}}")], "part int, value string")
    numbered = result_bindings(df).select(F.lit(1).alias("part"), "value")
    first = cut(numbered.withColumn("k", F.monotonically_increasing_id()))
    low = first.agg(F.min("k")).first()[0]
    rows = first.select("part", F.when(F.col("k") == (low if low is not None else -1), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"), "k")
    whole = rows.unionByName(ends.withColumn("k", F.lit(0).cast("bigint")))
    whole.repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)


def serialise(result) -> tuple[str, object]:
    """Kind of a query result and what to show: a boolean, triples or quads as text, or JSON rows."""
    if isinstance(result, bool):
        return "boolean", result
    if result.columns == ["s", "p", "o"]:
        return "graph", ntriples(result)
    if result.columns == ["g", "s", "p", "o"]:
        return "graphs", trig_blocks(result)
    return "solutions", result_json(result)
