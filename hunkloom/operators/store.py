"""Documents of the vector store: rules, past comments and chunks of code, and an upsert that embeds only what has changed.

A stored document is (collection, id, content, digest, metadata, embedding). An upsert compares digests of contents, so that a
second run over the same input embeds nothing; metadata is taken from the newer side either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import derive, providers
from . import chunking, history, vectors

# Names of the collections.
STANDARDS, REVIEWS = "coding_standards", "review_history"
KEY = ["collection", "id"]
SCHEMA = "collection string, id string, content string, digest string, metadata map<string,string>, embedding array<float>"


def rule_documents(rules: DataFrame, repo: Column) -> DataFrame:
    """Documents of coding rules (rule_id, title, description, category, severity, language, examples, tags) of a repository."""
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ","))
    meta = derive.present_keys(rule_id=F.col("rule_id"), title=F.col("title"), category=F.col("category"), severity=F.col("severity"), language=F.nullif("language", F.lit("")), tags=tags, repo=repo)
    return rules.select(F.lit(STANDARDS).alias("collection"), derive.hashed_id(repo, ":", F.col("rule_id")).alias("id"), chunking.rule_text(rules).alias("content"), meta.alias("metadata"))


def comment_documents(comments: DataFrame, repo: Column) -> DataFrame:
    """Documents of review comments (review_id, ordinal, severity, category, file_path, message, pr_number, author) of a repository."""
    meta = derive.present_keys(repo=repo, severity=F.col("severity"), category=F.col("category"), file_path=F.col("file_path"), pr_number=F.col("pr_number"), author=F.col("author"))
    text = history.comment_text(*(F.col(c) for c in ("severity", "category", "file_path", "message")))
    return comments.select(F.lit(REVIEWS).alias("collection"), derive.hashed_id(repo, ":", F.col("review_id"), ":", F.col("ordinal")).alias("id"), text.alias("content"), meta.alias("metadata"))


def chunk_documents(chunks: DataFrame, repo: str = "repo") -> DataFrame:
    """Documents of chunks of code (see `chunking.chunk_files`), a collection a repository."""
    meta = derive.present_keys(**{c: F.col(c) for c in ("file_path", "start_line", "end_line")}, repo=F.col(repo), **{c: F.nullif(c, F.lit("")) for c in ("language", "symbol_name", "symbol_kind")})
    return chunks.select(derive.collection(F.col(repo)).alias("collection"), "id", F.col("chunk").alias("content"), meta.alias("metadata"))


def pending(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One row a document of the batch, with its digest and, where the stored one has the same, that one's embedding. Of documents with
    equal keys in a batch the one with the largest content counts."""
    one = batch.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("content")))).where("_n = 1").drop("_n").withColumn("digest", F.sha2("content", 256))
    return one.join(stored.select(*KEY, "digest", "embedding"), [*KEY, "digest"], "left")


def upserted(stored: DataFrame, batch: DataFrame, embedder: str = "hashed") -> DataFrame:
    """The stored documents (SCHEMA) and those of the batch (collection, id, content, metadata), which replace stored ones of their keys."""
    new = pending(stored, batch)
    made = providers.embed_new(F.when(F.col("embedding").isNull(), F.col("content")), embedder)
    new = new.withColumn("embedding", F.coalesce("embedding", made))
    columns = ["collection", "id", "content", "digest", "metadata", "embedding"]
    return stored.join(batch.select(*KEY), KEY, "left_anti").select(columns).unionByName(new.select(columns))


def index_files(stored: DataFrame, files: DataFrame, embedder: str = "hashed") -> DataFrame:
    """The store with the chunks of files (repo, file_path, language, content): by symbols or windows, only changed chunks embedded."""
    return upserted(stored, chunk_documents(chunking.chunk_files(files)), embedder)


def load_standards(stored: DataFrame, documents: DataFrame, repo: Column, embedder: str = "hashed", category: str = "general") -> DataFrame:
    """The store with the rules that Markdown documents (doc_id, content, ...) hold for a repository."""
    rules = chunking.parse_standards(documents, "doc_id", category=category)
    about = [c for c in documents.columns if c != "content"]
    return upserted(stored, rule_documents(rules.join(documents.select(about), "doc_id"), repo), embedder)


def similar_comments(calls: DataFrame, stored: DataFrame, n: int = 5, embedder: str = "hashed") -> DataFrame:
    """Past comments on code like that of each call (query_id, repo, query or query_text), of its repository: rank, comment, severity, category, file_path, similarity."""
    meta = lambda k: F.coalesce(F.col("metadata")[k], F.lit("")).alias(k)
    own = stored.where(F.col("collection") == REVIEWS).withColumn("repo", F.col("metadata")["repo"]).select("id", "embedding", "repo", "content", meta("severity"), meta("category"), meta("file_path"))
    found = vectors.search(calls, own, n, by="repo", embedder=embedder)
    return found.select("query_id", "rank", F.col("content").alias("comment"), "severity", "category", "file_path", F.col("score").alias("similarity"))
