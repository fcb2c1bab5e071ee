"""The agent's tools as table functions: one row a call, one row a result. Calls carry a `call_id`.

`execute` goes from calls by name to answers; results are compact JSON, which leaves out what is null.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import derive, providers
from . import diff, security, signals, vectors

NAMES = ["review_diff", "check_security", "query_standards", "search_past_reviews", "generate_patch", "predict_bugs"]
# What the tools ask a language model for, and what is said of secrets.
REVIEW_REQUEST = "\nProvide your review as a JSON object with: summary, decision, and comments array."
PATCH_REQUEST = "Generate the corrected code that fixes this issue. Output ONLY the fixed code."
NO_CHANGES = "(no changes needed)"
NO_HISTORY = "No review history available."
#: What a model is told to be; a caller may tell it otherwise.
REVIEWER, FIXER = "You review changes of source code and answer with JSON.", "You correct source code and answer with the corrected code alone."


def review_message(diff_text: Column, language: Column, context: Column) -> Column:
    """The user's message of `review_diff`; an empty or null context has no line."""
    about = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Language: "), language, F.lit("\n"), about, F.lit("\nDiff to review:\n```diff\n"), diff_text, F.lit("\n```\n" + REVIEW_REQUEST))


def patch_message(path: Column, issue: Column, code: Column) -> Column:
    """The user's message of `generate_patch`."""
    return F.concat(F.lit("File: "), path, F.lit("\nIssue: "), issue, F.lit("\n\nOriginal code:\n```\n"), code, F.lit("\n```\n\n" + PATCH_REQUEST))


def unfenced(answer: Column) -> Column:
    """A model's code without the fence around it: first and last line go if there are more than two."""
    text = derive.strip(answer)
    lines = F.split(text, "\n", -1)
    return F.when(text.startswith("```") & (F.size(lines) > 2), F.array_join(F.slice(lines, 2, F.size(lines) - 2), "\n")).otherwise(text)


def check_security(calls: DataFrame) -> DataFrame:
    """(call_id, findings, count) of calls (call_id, code, language): secrets by line and then by rule; a language without an extension is text, which isn't scanned."""
    files = calls.select("call_id", F.concat(F.lit("code."), derive.snippet_extension(F.lower("language"))).alias("filename"), F.col("code").alias("content"))
    found = security.scan_secrets(files, ["call_id"])
    said = F.concat(F.lit(security.SECRET_SAID[0]), "title", F.lit(security.SECRET_SAID[1]))
    finding = F.struct(F.col("line_number").alias("line"), "rule_id", F.struct(F.col("line_number").alias("line"), "severity", "title", said.alias("description"), F.lit(security.SECRET_REMEDY).alias("remediation")).alias("f"))
    found = found.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(finding)), lambda x: x["f"]).alias("findings"))
    out = calls.select("call_id").join(found, "call_id", "left")
    return out.withColumn("findings", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType))).withColumn("count", F.size("findings"))


def query_store(calls: DataFrame, documents: DataFrame, limit: int = 5, embedder: str = "hashed") -> DataFrame:
    """The best documents (id, content, metadata, embedding) of each call (call_id, query or query_text, repo: null or empty for all, and its
    limit where there is such a column): rank, id, the first 300 characters, metadata, and the rounded relevance."""
    asked = calls.withColumnRenamed("call_id", "query_id").withColumns({"_repo": F.coalesce("repo", F.lit("")), "limit": F.coalesce("limit", F.lit(limit)) if "limit" in calls.columns else F.lit(limit)})
    most = (asked.agg(F.max("limit")).first()[0] or 0) if "limit" in calls.columns else limit
    own = documents.select("id", "content", "metadata", "embedding", F.coalesce(F.col("metadata")["repo"], F.lit("")).alias("group"))
    ask = [c for c in ("query", "query_text") if c in asked.columns]
    everywhere = vectors.search(asked.where("_repo = ''").select("query_id", *ask), own, most, embedder=embedder)
    # calls of a repository see its documents only: searched by repository
    within = vectors.search(asked.where("_repo <> ''").select("query_id", F.col("_repo").alias("group"), *ask), own, most, by="group", embedder=embedder)
    out = everywhere.unionByName(within).join(asked.select("query_id", "limit"), "query_id").where(F.col("rank") <= F.col("limit"))
    return out.select(F.col("query_id").alias("call_id"), "rank", "id", F.substring("content", 1, 300).alias("content"), "metadata", F.round("score", 3).alias("relevance"))


def _listed(calls: DataFrame, found: DataFrame, name: str, item: Column) -> DataFrame:
    """One row a call with its items by rank; a call without any has an empty list."""
    each = found.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))), lambda x: x["i"]).alias(name))
    return calls.select("call_id").join(each, "call_id", "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))


def query_standards(calls: DataFrame, documents: DataFrame | None, defaults: DataFrame | None = None, limit: int = 5, embedder: str = "hashed") -> DataFrame:
    """(call_id, standards, source): rules like what is asked for; without a store the first of the default standards, whose source is `defaults`."""
    meta = lambda k: F.coalesce(F.col("metadata")[k], F.lit("")).alias(k)
    if documents is not None:
        item = F.struct(meta("rule_id"), meta("title"), meta("category"), "content", "relevance")
        return _listed(calls, query_store(calls, documents, limit, embedder), "standards", item).withColumn("source", F.lit(None).cast("string"))
    rules = defaults.withColumn("rank", F.row_number().over(W.orderBy(F.col("ord"))))  # a short fixed list
    wanted = calls.select("call_id", (F.coalesce("limit", F.lit(limit)) if "limit" in calls.columns else F.lit(limit)).alias("limit"))
    all_rules = rules.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("rule_id", "title", "category", F.col("description").alias("content"), F.lit(None).cast("double").alias("relevance")).alias("i")))), lambda x: x["i"]).alias("_all"))
    return wanted.crossJoin(F.broadcast(all_rules)).select("call_id", F.slice("_all", F.lit(1), F.greatest("limit", F.lit(0))).alias("standards"), F.lit("defaults").alias("source"))  # one row on the right


def search_past_reviews(calls: DataFrame, documents: DataFrame | None, limit: int = 5, embedder: str = "hashed") -> DataFrame:
    """(call_id, past_reviews, note): past comments on code like that of a call; without a store none, and a note."""
    meta = lambda k: F.coalesce(F.col("metadata")[k], F.lit("")).alias(k)
    if documents is not None:
        item = F.struct(F.col("content").alias("comment"), meta("severity"), meta("category"), meta("file_path"), "relevance")
        return _listed(calls, query_store(calls, documents, limit, embedder), "past_reviews", item).withColumn("note", F.lit(None).cast("string"))
    none = F.array().cast("array<struct<comment string, severity string, category string, file_path string, relevance double>>")
    return calls.select("call_id", none.alias("past_reviews"), F.lit(NO_HISTORY).alias("note"))


def asked(calls: DataFrame, prompt: Column, model: str) -> DataFrame:
    """The calls with what a model answers to the prompt, and the error where it fails."""
    f = providers.provider(providers.MODELS, model)

    @F.pandas_udf("struct<content string, error string>")
    def run(s: pd.Series) -> pd.DataFrame:
        found = providers.answers(f, s.fillna("").tolist())
        return pd.DataFrame({"content": pd.Series([c for c, _, _ in found], dtype=object), "error": pd.Series([e for _, _, e in found], dtype=object)})

    return calls.withColumn("_a", run(prompt)).select(*calls.columns, "_a.*")


def review_diff(calls: DataFrame, model: str = "fixed", system: str = REVIEWER) -> DataFrame:
    """(call_id, content, error) of calls (call_id, diff, language, context): the model's review as it is."""
    text = review_message(F.col("diff"), F.col("language"), F.col("context"))
    return asked(calls, F.concat(F.lit(system + "\n\n"), text), model).select("call_id", "content", "error")


def generate_patch(calls: DataFrame, model: str = "fixed", system: str = FIXER) -> DataFrame:
    """(call_id, patch, error) of calls (call_id, code, issue_description, file_path): the difference between the code and the model's, as a unified diff."""
    said = asked(calls, F.concat(F.lit(system + "\n\n"), patch_message(F.col("file_path"), F.col("issue_description"), F.col("code"))), model)

    @F.pandas_udf("string")
    def diff_of(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        rows = zip(path, before, after, strict=True)
        return pd.Series([None if a is None else "".join(difflib.unified_diff((b or "").splitlines(keepends=True), a.splitlines(keepends=True), f"a/{p}", f"b/{p}")) or NO_CHANGES for p, b, a in rows], dtype=object)

    return said.select("call_id", diff_of("file_path", "code", unfenced(F.col("content"))).alias("patch"), "error")


def predict_bugs(calls: DataFrame) -> DataFrame:
    """(call_id, risk_score, risk_level, signals, recommendations) of calls (call_id, diff): the diff is that of one modified file named `file`."""
    changes = lambda sign: (F.size(F.split("diff", f"\\n\\{sign}", -1)) - 1).cast("int")
    files = calls.select(F.col("call_id").alias("pr_id"), F.lit(1).alias("file_ord"), F.lit("file").alias("filename"), F.lit("modified").alias("status"), changes("+").alias("additions"), changes("-").alias("deletions"), F.col("diff").alias("patch"))
    found = signals.signals(files, diff.parse_patches(files))
    item = F.struct("signal_ord", F.struct(F.col("signal_type").alias("type"), "risk_level", "description", F.col("filename").alias("file"), F.round("confidence", 2).alias("confidence")).alias("s"))
    listed = found.groupBy("pr_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("signals"))
    out = signals.scores(files, found).join(listed, "pr_id", "left")
    return out.select(F.col("pr_id").alias("call_id"), F.round("risk_score", 3).alias("risk_score"), "risk_level", F.coalesce("signals", F.array().cast(listed.schema["signals"].dataType)).alias("signals"), "recommendations")


# What each tool can't do without, in the order in which it is looked for.
REQUIRED = {"review_diff": ["diff", "language"], "check_security": ["code", "language"], "query_standards": ["query"], "search_past_reviews": ["code_snippet"], "generate_patch": ["code", "issue_description", "file_path"], "predict_bugs": ["diff"]}
ARGUMENTS = "diff string, language string, context string, code string, query string, repo string, limit int, code_snippet string, issue_description string, file_path string"


def execute(calls: DataFrame, standards: DataFrame | None = None, reviews: DataFrame | None = None, defaults: DataFrame | None = None, model: str = "fixed", embedder: str = "hashed") -> DataFrame:
    """(call_id, answer) of calls (call_id, name, arguments: a JSON object): each goes to its tool, and what that finds, as JSON, into the protocol's
    envelope. Unknown names, missing arguments and failing models are errors of their call alone."""
    rows = calls.select("call_id", "name", F.from_json(F.coalesce("arguments", F.lit("{}")), ARGUMENTS).alias("a"))
    missing = F.lit(None).cast("string")
    for tool, names in REQUIRED.items():
        for n in reversed(names):
            missing = F.when((F.col("name") == tool) & F.col(f"a.{n}").isNull(), f"'{n}'").otherwise(missing)
    rows = rows.select("call_id", "name", "a.*", missing.alias("missing"))
    own = lambda tool: rows.where((F.col("name") == tool) & F.col("missing").isNull())
    plain = lambda df, *c: df.select("call_id", F.to_json(F.struct(*c)).alias("result"), F.lit(None).cast("string").alias("failed"))
    parts = [
        review_diff(own("review_diff"), model).select("call_id", F.col("content").alias("result"), F.col("error").alias("failed")),
        plain(check_security(own("check_security")), "findings", "count"),
        plain(query_standards(own("query_standards").withColumnRenamed("query", "query_text"), standards, defaults, embedder=embedder), "standards", "source"),
        plain(search_past_reviews(own("search_past_reviews").select("call_id", "repo", "limit", F.col("code_snippet").alias("query_text")), reviews, embedder=embedder), "past_reviews", "note"),
        generate_patch(own("generate_patch"), model).select("call_id", F.col("patch").alias("result"), F.col("error").alias("failed")),
        plain(predict_bugs(own("predict_bugs")), "risk_score", "risk_level", "signals", "recommendations"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    out = rows.select("call_id", "name", "missing").join(found, "call_id", "left")
    return out.select("call_id", answer(F.col("name"), F.col("result"), F.coalesce("missing", "failed")).alias("answer"))


def answer(name: Column, result: Column, error: Column) -> Column:
    """A tool's result as the protocol's content: an unknown name or an error is marked."""
    text = F.when(~name.isin(NAMES), F.concat(F.lit("Unknown tool: "), name)).when(error.isNotNull(), F.concat(F.lit("Error: "), error)).otherwise(result)
    failed = ~name.isin(NAMES) | error.isNotNull()
    content = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    return F.when(failed, F.to_json(F.struct(content.alias("content"), F.lit(True).alias("isError")))).otherwise(F.to_json(F.struct(content.alias("content"))))
