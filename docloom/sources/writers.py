"""Sinks: counted JSON lines, write-once tables, releases with a pointer, postings, structured tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import lexical
from docloom.operators.lineage import fingerprint


def write_json_lines(df: DataFrame, path: str) -> int:
    """Write and count in one pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path)
    return seen.get["rows"]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def _moved(spark: SparkSession, source: str, target: str, replace: bool = False) -> bool:
    """Rename in one step. False if the target is there and isn't to be replaced."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    fs = jvm.org.apache.hadoop.fs
    rule = getattr(fs, "Options$Rename")
    rules = spark.sparkContext._gateway.new_array(rule, 1)  # noqa: SLF001
    rules[0] = rule.OVERWRITE if replace else rule.NONE
    a, b = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(_file_system(spark, target)[0].getUri(), spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    try:
        context.rename(a, b, rules)
    except Exception:
        if not replace and exists(spark, target):
            return False
        raise
    return True


def put_in_place(spark: SparkSession, target: str, write) -> bool:
    """write(path) into a folder of its own, then rename it: a run that dies leaves nothing at the target, and of two at once one is kept. False if the target was there."""
    if exists(spark, target):
        return False
    own = f"{target}.part-{uuid.uuid4().hex}"
    write(own)
    if _moved(spark, own, target):
        return True
    fs, where = _file_system(spark, own)
    fs.delete(where, True)
    return False


def write_once(df: DataFrame, path: str, key: str, content: Column) -> bool:
    """Write a table that never changes. True if written, False if the same rows are there; other rows are an error."""
    spark = df.sparkSession
    if put_in_place(spark, path, lambda own: df.write.parquet(own)):
        return True
    old, new = (fingerprint(x, key, content).first()[0] for x in (spark.read.parquet(path), df))
    if old != new:
        raise ValueError(f"{path} holds other rows")
    return False


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """One small new file. False if it is there."""
    fs, where = _file_system(spark, path)
    try:
        out = fs.create(where, False)
    except Exception:
        if exists(spark, path):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, put in the place of the old one in one step: readers see the old text or the new one, also if the run dies."""
    own = f"{path}.part-{uuid.uuid4().hex}"
    _create(spark, own, text)
    _moved(spark, own, path, replace=True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def publish(chunks: DataFrame, embeddings: DataFrame, root: str, key: str = "chunk_id") -> str:
    """Write a release under an id made of its content, check it, and return the id. Publishing the same content again changes nothing."""
    spark = chunks.sparkSession
    content = F.to_json(F.struct(*sorted(chunks.columns)), {"ignoreNullFields": "false"})
    release_id = "rel_" + fingerprint(chunks, key, content).first()[0][:24]
    base = f"{root}/releases/{release_id}"
    write_once(chunks, f"{base}/chunks", key, content)
    write_once(embeddings, f"{base}/embeddings", key, F.to_json(F.struct("embedding")))
    written = spark.read.parquet(f"{base}/chunks")
    if missing := written.join(spark.read.parquet(f"{base}/embeddings"), key, "left_anti").limit(1).collect():
        raise ValueError(f"no embedding for {missing[0][key]}")
    write_text(spark, f"{base}/manifest.json", json.dumps({"release_id": release_id, "chunks": written.count()}, sort_keys=True))
    return release_id


def activate(spark: SparkSession, root: str, release_id: str) -> None:
    """Point to a release that is whole, and note it in the history."""
    told = json.loads(read_text(spark, f"{root}/releases/{release_id}/manifest.json"))
    if spark.read.parquet(f"{root}/releases/{release_id}/chunks").count() != told["chunks"]:
        raise ValueError(f"release {release_id} isn't whole")
    n = active_history(spark, root).count()
    while not _create(spark, f"{root}/active_history/{n:012d}.json", json.dumps({"ordinal": n, "release_id": release_id})):
        n += 1  # another one has taken this number
    write_text(spark, f"{root}/active.json", json.dumps({"release_id": release_id}))


def active_history(spark: SparkSession, root: str) -> DataFrame:
    """(ordinal, release_id): one file each, whose name is its number, so a number is given once."""
    path, schema = f"{root}/active_history", "ordinal long, release_id string"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def active(spark: SparkSession, root: str) -> str:
    return json.loads(read_text(spark, f"{root}/active.json"))["release_id"]


def roll_back(spark: SparkSession, root: str, release_id: str) -> None:
    """Point to an earlier release again."""
    if active_history(spark, root).where(F.col("release_id") == release_id).isEmpty():
        raise ValueError(f"{release_id} was never active")
    activate(spark, root, release_id)


def write_postings(docs: DataFrame, id_col: str, tokens: Column, root: str) -> lexical.Index:
    """The inverted index as tables: blocks of postings by shard, from which everything else is read. Texts are shuffled once."""
    spark = docs.sparkSession
    lexical.corpus_of(docs, tokens).write.mode("overwrite").parquet(f"{root}/corpus")
    lexical.blocked(docs, id_col, tokens, spark.read.parquet(f"{root}/corpus")).write.mode("overwrite").parquet(f"{root}/blocks")
    blocks = spark.read.parquet(f"{root}/blocks")
    blocks.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df")).write.mode("overwrite").parquet(f"{root}/terms")
    lexical.members_of(blocks).write.mode("overwrite").parquet(f"{root}/members")
    return read_postings(spark, root)


#: The layout of stored postings; a change of tables or columns takes a new number.
POSTINGS_FORMAT = 6


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _tree(*nodes) -> Iterator:
    """The nodes of a plan or of expressions, and all below them."""
    for node in nodes:
        yield node
        yield from _tree(*_items(node.children()))


def plan_text(df: DataFrame) -> str:
    """What df computes, in words that don't depend on the session: tables of one relation of files only, without Python functions or random numbers, whose text wouldn't tell two apart."""
    spark, key = df.sparkSession, "spark.sql.debug.maxToStringFields"
    analyzed = df._jdf.queryExecution().analyzed()  # noqa: SLF001
    leaves = analyzed.collectLeaves()
    if leaves.size() != 1 or leaves.apply(0).getClass().getSimpleName() != "LogicalRelation":
        raise ValueError("an index is stored of rows that are read from one table of files")
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 20))
    try:
        told = analyzed.canonicalized().toString()
    finally:
        spark.conf.set(key, before)
    kinds = {e.getClass().getSimpleName() for node in _tree(analyzed) for e in _tree(*_items(node.expressions()))}
    if not analyzed.deterministic() or any("UDF" in k for k in kinds):
        raise ValueError("the text of a function of the user's doesn't tell what it does: write the index by write_postings")
    return told


def postings_root(docs: DataFrame, id_col: str, tokens: Column, folder: str) -> str:
    """Where the index of docs is stored: named by the state of the files, what is computed from their rows (filters, tokenizer, ids) and the format."""
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = fingerprint(files.withColumn("k", F.col("file_path")), "k", F.to_json(F.struct(*files.columns))).first()[0]
    told = plan_text(docs.select(F.col(id_col), tokens))
    return f"{folder}/docloom-postings-{hashlib.sha256(f'{POSTINGS_FORMAT} {state} {told}'.encode()).hexdigest()[:24]}"


def stored_postings(docs: DataFrame, id_col: str, tokens: Column, folder: str) -> lexical.Index:
    """The index of rows read from files, written to the folder once for each state of the files, filter, tokenizer and format, and read back ever after."""
    root = postings_root(docs, id_col, tokens, folder)
    put_in_place(docs.sparkSession, root, lambda own: write_postings(docs, id_col, tokens, own))
    return read_postings(docs.sparkSession, root)


def read_postings(spark: SparkSession, root: str) -> lexical.Index:
    terms, corpus, blocks, members = (spark.read.parquet(f"{root}/{t}") for t in ("terms", "corpus", "blocks", "members"))
    return lexical.Index(lexical.postings_of(blocks, members), terms, corpus, blocks, members)


def embed_missing(rows: DataFrame, embed, model: str, dims: int, text: str = "text") -> DataFrame:
    """rows with embeddings made for those that have none or another model's. ``embed``: a list of texts to a list of vectors, called a batch at a time."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def made(texts: pd.Series) -> pd.Series:
        out = embed(texts.tolist())
        if len(out) != len(texts) or any(len(v) != dims for v in out):
            raise ValueError("the embedder returned other sizes")
        return pd.Series([[float(x) for x in v] for v in out])

    stale = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))
    fresh = rows.where(stale).withColumn("embedding", made(F.col(text))).withColumn("embedding_model", F.lit(model))
    return rows.where(~stale).unionByName(fresh)


def pseudo_embedding(text: Column, dims: int) -> Column:
    """A deterministic stand-in for a model: digest bytes / 255 - 0.5."""
    blocks = -(-dims // 32)
    digits = F.concat(*(F.sha2(F.concat(text, F.lit(f"#{i}")), 256) for i in range(blocks)))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (byte(i) / 255.0 - 0.5).cast("float"))


def structured_tables(documents: DataFrame, facts: DataFrame, aliases: dict[str, list[str]], root: str, contract: str = "contract") -> None:
    """Documents, facts and aliases as three tables; repeated documents or facts of several contracts are errors."""
    if bad := documents.groupBy("document_id").count().where("count > 1").limit(1).collect():
        raise ValueError(f"document twice: {bad[0]['document_id']}")
    if facts.agg(F.count_distinct(contract)).first()[0] > 1:
        raise ValueError("facts of several contracts")
    spark = documents.sparkSession
    rows = [(g, a, "".join(a.casefold().split())) for g, its in aliases.items() for a in its]
    documents.write.mode("overwrite").parquet(f"{root}/documents")
    facts.write.mode("overwrite").parquet(f"{root}/facts")
    spark.createDataFrame(rows, "alias_group string, alias string, alias_normalized string").write.mode("overwrite").parquet(f"{root}/target_aliases")


class ActiveRelease:
    """The tables of the active release, read again when the pointer's text changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._told, self._tables = spark, root, None, {}

    def table(self, name: str) -> DataFrame:
        told = read_text(self.spark, f"{self.root}/active.json")
        if told != self._told:
            self._told, self._tables = told, {}
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/releases/{json.loads(told)['release_id']}/{name}")
        return self._tables[name]
