"""Sources: document listings, JSON and JSON lines, marked page texts, provider responses, gold labels, event streams, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.markup import marked_pages



def documents_in(spark: SparkSession, root: str, pattern: str = "*.pdf", issuers: list[str] | None = None, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(document_id, issuer, card_name, path, sha256, length) of files at root/<issuer>/<name>, in folded path order. Contents are read only for the digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/*/")
    parts = F.split(F.col("path"), "/")
    rows = files.select(F.element_at(parts, -2).alias("issuer"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "").alias("card_name"), "path", F.sha2("content", 256).alias("sha256"), "length")
    if issuers is not None:
        rows = rows.where(F.col("issuer").isin(issuers))
    if names is not None:
        rows = rows.where(F.col("card_name").isin(names))
    rows = rows.select(F.concat_ws("/", "issuer", "card_name").alias("document_id"), "*").orderBy(F.lower("path"), "path")
    return rows if limit is None else rows.limit(limit)


def manifest(spark: SparkSession, path: str, schema: str = "document_id string, path string, sha256 string") -> DataFrame:
    """Rows of a manifest that is a list or holds one as ``documents``; repeated ids are an error."""
    text = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{_colons(schema)}>>"
    listed = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.documents"))
    rows = text.select(F.explode(F.from_json(listed, kind)).alias("d")).select("d.*")
    many = rows.groupBy("document_id").count().where("count > 1").limit(1).collect()
    if many:
        raise ValueError(f"document id twice in the manifest: {many[0]['document_id']}")
    return rows.orderBy("document_id")


def _colons(ddl: str) -> str:
    return ",".join(":".join(part.split(maxsplit=1)) for part in ddl.split(", "))


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One document a file; a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a path that doesn't exist has none."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except Exception as error:  # only the missing path
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def lane(spark: SparkSession, path: str, pages: str = "array<struct<page:int,text:string,status:string>>", facts: str = "array<map<string,string>>") -> DataFrame:
    """Lane payloads with ``valid``: an id and arrays of pages and facts."""
    rows = json_documents(spark, path, f"document_id string, provider string, source_pdf_sha256 string, structure_schema_version string, pages {pages}, facts {facts}")
    return rows.withColumn("valid", F.col("document_id").isNotNull() & F.col("pages").isNotNull() & F.col("facts").isNotNull())


def pages_of(texts: DataFrame, key: str, marker: str, text: str = "text") -> DataFrame:
    """(key, page, text) of marked page texts; see repeated_pages for what is wrong with them."""
    return texts.select(key, F.explode(marked_pages(F.col(text), marker)).alias("p")).select(key, "p.page", "p.text")


def repeated_pages(pages: DataFrame, key: str) -> DataFrame:
    return pages.groupBy(key, "page").count().where("count > 1")


def filled_pages(documents: DataFrame, pages: DataFrame, key: str = "document_id", count: str = "page_count") -> DataFrame:
    """A row for each page from 1 to the count; pages a response lacks have status 'missing', pages beyond it are dropped."""
    wanted = documents.where(F.col(count) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(count))).alias("page"))
    return wanted.join(pages, [key, "page"], "left").withColumn("status", F.coalesce("status", F.lit("missing"))).withColumn("text", F.coalesce("text", F.lit("")))


def element_pages(responses: DataFrame, key: str = "document_id", elements: str = "elements") -> DataFrame:
    """(key, page, text, blocks, tables) of responses that list elements (id, category, page, content, coordinates) in reading order; page 1 by default."""
    rows = responses.select(key, F.posexplode(elements).alias("at", "e"))
    content = F.coalesce(*(F.when(F.trim(F.col(f"e.content.{c}")) != "", F.col(f"e.content.{c}")) for c in ("markdown", "html", "text")), F.lit(""))
    points = F.col("e.coordinates")
    corner = lambda f, c: f(F.transform(points, lambda p: p[c]))
    bbox = F.when(F.size(points) > 0, F.struct(corner(F.array_min, "x").alias("x1"), corner(F.array_min, "y").alias("y1"), corner(F.array_max, "x").alias("x2"), corner(F.array_max, "y").alias("y2")))
    block = F.struct(F.col("at").alias("reading_order"), F.col("e.category").alias("type"), content.alias("text"), bbox.alias("bbox"), F.col("e.id").cast("string").alias("source_id"))
    flat = rows.select(key, F.coalesce("e.page", F.lit(1)).alias("page"), block.alias("block"))
    blocks = F.array_sort(F.collect_list("block"))
    pages = flat.groupBy(key, "page").agg(blocks.alias("blocks"))
    told = F.filter("blocks", lambda b: F.trim(b["text"]) != "")
    return pages.withColumns({"text": F.array_join(F.transform(told, lambda b: F.trim(b["text"])), "\n\n"), "tables": F.filter("blocks", lambda b: b["type"] == "table")})


def indexed_pages(responses: DataFrame, key: str = "document_id", pages: str = "pages") -> DataFrame:
    """(key, page, text, status) of responses whose pages count from 0."""
    return responses.select(key, F.explode(pages).alias("p")).select(key, (F.col("p.index") + 1).alias("page"), F.coalesce("p.markdown", F.lit("")).alias("text"), F.lit("success").alias("status"))


def last_event(events: DataFrame, by: list[str], order: str, wanted: Column, value: Column, name: str) -> DataFrame:
    """(by, name): the value of the last event that is wanted."""
    return events.groupBy(*by).agg(F.max_by(value, F.when(wanted, F.col(order))).alias(name))


def gold_queries(labels: DataFrame) -> DataFrame:
    """Queries of numeric and field labels of gold documents: one for each document, page and label id, numeric labels first."""
    numeric = labels.select("document_id", F.posexplode("numeric_labels").alias("at", "l"), F.lit(0).alias("kind_order"), F.lit("numeric").alias("kind"))
    fields = labels.select("document_id", F.posexplode("field_labels").alias("at", "l"), F.lit(1).alias("kind_order"), F.lit("field").alias("kind"))
    shared = [c for c in ("id", "page_num", "context_terms", "critical") if c in labels.select(F.explode("numeric_labels").alias("l")).select("l.*").columns]
    pick = lambda df, answer: df.select("document_id", "at", "kind_order", "kind", *(F.col(f"l.{c}").alias(c) for c in shared), answer.cast("string").alias("expected_answer"))
    rows = pick(numeric, F.col("l.surface_text")).unionByName(pick(fields, F.col("l.value")))
    first = F.min(F.struct("kind_order", "at", "kind", *[c for c in shared if c not in ("id", "page_num")], "expected_answer"))
    return rows.groupBy("document_id", "page_num", "id").agg(first.alias("q")).select("document_id", "page_num", "id", "q.*").drop("kind_order", "at")


def catalogue(chunks: DataFrame, key: str = "document_id", columns: tuple[str, ...] = ("issuer", "card_name")) -> DataFrame:
    """Distinct documents; one with several identities is an error."""
    rows = chunks.select(key, *columns).distinct()
    if bad := rows.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"document of several identities: {bad[0][key]}")
    return rows.orderBy(key)


def filter_catalogue(chunks: DataFrame, issuer: str, card: str, path: str | None = None) -> DataFrame:
    """(issuer, cards array<struct<card, chunks>>) for a filter menu; issuers in case-insensitive order."""
    keys = [issuer, card, *([path] if path else [])]
    rows = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"))
    cards = F.array_sort(F.collect_list(F.struct(F.lower(card).alias("folded"), F.col(card).alias("card"), "chunks")))
    return rows.groupBy(issuer).agg(F.transform(cards, lambda c: F.struct(c["card"].alias("card"), c["chunks"].alias("chunks"))).alias("cards")).orderBy(F.lower(issuer), issuer)


def release_chunks(spark: SparkSession, root: str, release_id: str, expected: int | None = None) -> DataFrame:
    """Chunks of a release, in id order; a wrong row count fails."""
    chunks = spark.read.parquet(f"{root}/releases/{release_id}/chunks")
    if expected is not None and (n := chunks.count()) != expected:
        raise ValueError(f"release {release_id} holds {n} chunks, not {expected}")
    return chunks.orderBy("chunk_id")


def vectors_for(ids: DataFrame, vectors: DataFrame, key: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    """Vectors of the asked ids in the asked order, with ``finite``; missing ids keep a null vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ids.join(vectors, key, "left").withColumn("finite", F.coalesce(finite, F.lit(False))).orderBy(order)
