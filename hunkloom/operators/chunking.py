"""Source text as chunks of lines, coding standards as rules, and joins of intervals with lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.derive import hashed_id, strip
from .symbols import chunk_symbols

MAX_CHARS, OVERLAP = 2000, 5
HEADING = r"^##\s+(?:([A-Z]+-\d+)\s*:\s*)?(.+)$"
METADATA = r"<!--\s*(\w+)\s*:\s*([^>]+?)\s*-->"


def lines_per_chunk(content: Column, n: Column, max_chars: int = MAX_CHARS) -> Column:
    average = F.greatest(F.lit(1), F.floor(F.length(content) / F.greatest(n, F.lit(1))))
    return F.greatest(F.lit(10), F.floor(F.lit(max_chars) / average)).cast("int")


def window_chunks(files: DataFrame, repo: str = "repo", path: str = "file_path", content: str = "content", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, base_line: Column | None = None, whole: Column | None = None) -> DataFrame:
    """Windows of lines that overlap; the last one ends with the text. Blank texts have none; where `whole` holds, a text is one window."""
    base = F.lit(1) if base_line is None else base_line
    rows = files.where(strip(F.col(content)) != "").withColumn("_lines", F.split(content, "\n", -1)).withColumn("_n", F.size("_lines"))
    per = lines_per_chunk(F.col(content), F.col("_n"), max_chars)
    rows = rows.withColumn("_per", per if whole is None else F.when(whole, F.greatest(F.col("_n"), F.lit(overlap + 1))).otherwise(per))
    step = F.col("_per") - overlap
    last = F.ceil(F.greatest(F.col("_n") - F.col("_per"), F.lit(0)) / step).cast("int") * step
    rows = rows.select(*files.columns, "_lines", "_n", "_per", F.explode(F.sequence(F.lit(0), last, step)).alias("_i"))
    start, end = (base + F.col("_i")).cast("int"), (base + F.least(F.col("_i") + F.col("_per"), F.col("_n")) - 1).cast("int")
    rows = rows.withColumns({"start_line": start, "end_line": end, "chunk": F.array_join(F.slice("_lines", F.col("_i") + 1, F.col("_per")), "\n")})
    return rows.withColumn("id", hashed_id(F.col(repo), ":", F.col(path), ":", F.col("start_line"), "-", F.col("end_line"))).drop("_lines", "_n", "_per", "_i")


def chunk_files(files: DataFrame, repo: str = "repo", path: str = "file_path", language: str = "language", content: str = "content", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of files by language, in one pass and without an exchange: one for each symbol outside classes, or windows of it where
    it is too long; windows of the file where its language has no parser, it has an error or no symbols."""
    rows = files.select(repo, path, language, content).withColumn("_symbols", chunk_symbols(F.col(language), F.col(content)))
    lines = F.split(content, "\n", -1)
    text = lambda s: F.array_join(F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")
    piece = lambda name, kind, start, body: F.struct(name.alias("symbol_name"), kind.alias("symbol_kind"), start.alias("_from"), body.alias("_text"))
    own = F.transform("_symbols", lambda s: piece(s["name"], s["kind"], s["start_line"], text(s)))
    none = F.lit(None).cast("string")
    pieces = rows.select(repo, path, language, F.explode(F.when(F.size("_symbols") > 0, own).otherwise(F.array(piece(none, none, F.lit(1), F.col(content))))).alias("_p")).select(repo, path, language, "_p.*")
    found = window_chunks(pieces, repo, path, "_text", max_chars, overlap, F.col("_from"), F.col("symbol_name").isNotNull() & (F.length("_text") <= max_chars))
    return found.select(repo, path, language, "symbol_name", "symbol_kind", "start_line", "end_line", "chunk", "id")


def sections(docs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Heading and body of each section that begins with `## `; what comes before the first goes."""
    rows = docs.select(key, content).repartition(key).select(key, F.posexplode(F.split(content, "\n", -1)).alias("i", "line"))
    head = F.col("line").startswith("## ")
    so_far = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("section", F.count_if(head).over(so_far).cast("int")).where("section > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("i", "line")))), lambda x: x["line"])
    return rows.groupBy(key, "section").agg(F.max(F.when(head, F.col("line"))).alias("heading"), body.alias("body"))


def _outside(lines: Column) -> Column:
    """Fold lines into (inside a fence, text lines outside, closed blocks, block so far)."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("text"), F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("block"))

    def step(s: Column, line: Column) -> Column:
        fence = line.startswith("```")
        closes = fence & s["inside"]
        return F.struct(
            F.when(fence, ~s["inside"]).otherwise(s["inside"]).alias("inside"),
            F.when(fence | s["inside"], s["text"]).otherwise(F.concat(s["text"], F.array(line))).alias("text"),
            F.when(closes, F.concat(s["blocks"], F.array(F.array_join(s["block"], "\n")))).otherwise(s["blocks"]).alias("blocks"),
            F.when(closes, F.array().cast("array<string>")).when(s["inside"] & ~fence, F.concat(s["block"], F.array(line))).otherwise(s["block"]).alias("block"),
        )

    return F.aggregate(lines, start, step)


def metadata_value(body: Column, key: str) -> Column:
    """The last value of a key in comments of the form `<!-- key: value -->`."""
    found = F.arrays_zip(F.regexp_extract_all(body, F.lit(METADATA), 1).alias("k"), F.regexp_extract_all(body, F.lit(METADATA), 2).alias("v"))
    return F.try_element_at(F.transform(F.filter(found, lambda x: x["k"] == key), lambda x: strip(x["v"])), F.lit(-1))


def parse_standards(docs: DataFrame, key: str, content: str = "content", category: str = "general") -> DataFrame:
    """Coding rules of Markdown documents, one for each section whose heading reads as one."""
    rules = sections(docs, key, content).where(F.col("heading").rlike(HEADING))
    number = F.row_number().over(W.partitionBy(key).orderBy("section"))
    whole = F.array_join("body", "\n")
    rules = rules.withColumns({"text": whole, "number": number})
    bare = F.split(F.regexp_replace("text", METADATA, ""), "\n", -1)
    examples = F.array_join(_outside(F.split("text", "\n", -1))["blocks"], "\n---\n")
    tags = metadata_value(F.col("text"), "tags")
    return rules.select(key, "section", F.coalesce(F.nullif(F.regexp_extract("heading", HEADING, 1), F.lit("")), F.format_string("RULE-%03d", "number")).alias("rule_id"), strip(F.regexp_extract("heading", HEADING, 2)).alias("title"), strip(F.array_join(_outside(bare)["text"], "\n")).alias("description"), F.coalesce(metadata_value(F.col("text"), "category"), F.lit(category)).alias("category"), F.coalesce(metadata_value(F.col("text"), "severity"), F.lit("medium")).alias("severity"), metadata_value(F.col("text"), "language").alias("language"), F.nullif(examples, F.lit("")).alias("examples"), F.when(F.coalesce(tags, F.lit("")) != "", F.split(tags, ",")).otherwise(F.array().cast("array<string>")).alias("tags"))


def rule_text(rules: DataFrame) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("["), "rule_id", F.lit("] "), "title"), "description", F.when(F.col("examples").isNotNull(), F.concat(F.lit("Examples:\n"), "examples")))


#: Lines of a bucket at each level; an interval belongs to the first level that is no shorter than it.
LEVELS = [16, 256, 4096, 65536, 2**31 - 1]


def _holding(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, key: str) -> DataFrame:
    """Points joined with the intervals of their key that hold them, met by buckets of lines: a point is sent to one bucket a level, an
    interval to two at most, so what meets grows with the lines and not with their square, and one large file is many keys."""
    length = F.col(end) - F.col(start) + 1
    level = F.lit(LEVELS[-1])
    for size in reversed(LEVELS[:-1]):
        level = F.when(length <= size, size).otherwise(level)
    bucket = lambda c: F.floor(F.col(c) / F.col("_level"))
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("_bucket", bucket(at))
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(i, [key, "_level", "_bucket"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_level", "_bucket")


def innermost(points: DataFrame, intervals: DataFrame, key: str, line: str = "line") -> DataFrame:
    """The shortest interval (key, start_line, end_line, ord) that holds each point; the first of equal ones."""
    hit = _holding(points, line, intervals, "start_line", "end_line", key)
    return hit.groupBy(key, line).agg(F.min_by(F.struct("start_line", "end_line", "ord"), F.struct(F.col("end_line") - F.col("start_line"), F.col("ord"))).alias("s")).select(key, line, "s.*")


def overlapping(ranges: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Intervals (start_line, end_line) that overlap each range (key, from_line, to_line): those that hold its first line, and those that begin behind it, within the range."""
    holding = _holding(ranges.where("from_line <= to_line"), "from_line", intervals, "start_line", "end_line", key)
    within = _holding(intervals.where("start_line <= end_line"), "start_line", ranges, "from_line", "to_line", key).where("start_line > from_line")
    return holding.unionByName(within.select(holding.columns))
