"""Unified diffs as line tables.

A patch is one row, and all that its lines need to know of each other (hunk, position, line numbers, turns from
removed to added) is worked out inside that row: running sums over an Arrow batch of patches, without an exchange or a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import derive

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
NAMED = r"^@@ -(?P<a>\d+)(?:,(?P<b>\d+))? \+(?P<c>\d+)(?:,(?P<d>\d+))? @@"
FILE = ["pr_id", "file_ord"]
KINDS = ["hunk_header", "added", "removed", "context"]
STARTS = ["old_start", "old_count", "new_start", "new_count"]
#: Bytes of patches that are cut into lines at once.
BLOCK_BYTES = 8 << 20


def with_defaults(files: DataFrame) -> DataFrame:
    """File rows with the defaults of missing fields, and their language."""
    return files.withColumns({"filename": F.coalesce("filename", F.lit("")), "status": F.coalesce("status", F.lit("modified")), "additions": F.coalesce("additions", F.lit(0)), "deletions": F.coalesce("deletions", F.lit(0)), "patch": F.coalesce("patch", F.lit(""))}).withColumn("language", derive.language(F.col("filename")))


def with_flags(files: DataFrame) -> DataFrame:
    """File rows with the sum of their changes, and whether they are new, deleted or renamed."""
    status = F.col("status")
    return files.withColumns({"total_changes": F.col("additions") + F.col("deletions"), "is_new_file": status == "added", "is_deleted": status == "removed", "is_renamed": status == "renamed"})


def status_counts(files: DataFrame) -> DataFrame:
    """How many files of each pull request are modified, added and deleted."""
    return files.groupBy("pr_id").agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("modified", "modified"), ("added", "added"), ("removed", "deleted"))))


def of_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(derive.language(F.col("filename")) == language)


def skipped(files: DataFrame) -> DataFrame:
    """Pull requests without a file to review."""
    none = F.count_if(derive.reviewable(F.col("filename"), F.col("status"))) == 0
    return files.groupBy("pr_id").agg(none.alias("none")).where("none").select("pr_id", F.lit("skipped").alias("status"))


def _numbers(headers: pa.Array) -> list[np.ndarray]:
    """The four numbers of each header (counts: 1 where there is none) and whether they fit an int."""
    found = pc.extract_regex(headers, NAMED)
    out = []
    for k, name in enumerate("abcd"):
        values = [int(x) if x and len(x) < 20 else -1 if not x else 2**40 for x in found.field(name).to_pylist()]
        numbers = np.array(values, np.int64)
        bad = (numbers < 0) | (numbers >= 2**31)
        out.append(np.where(bad, 1, numbers) if k % 2 else np.where(bad, -1, numbers))
    return out


def _lines_of(batch: pa.RecordBatch) -> dict[str, pa.Array | np.ndarray]:
    """Columns of the lines of a batch's patches, and the row of each."""
    split = pc.split_pattern(batch.column("patch").cast(pa.large_string()), "\n")
    row, raw = pc.list_parent_indices(split).to_numpy(), split.flatten()
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    lead = np.where(offsets[1:] > offsets[:-1], data[np.minimum(offsets[:-1], len(data) - 1)], ord(" "))
    kind = np.select([lead == ord("+"), lead == ord("-"), lead == ord(" ")], [1, 2, 3], -1)
    at = np.flatnonzero(lead == ord("@"))
    at = at[pc.match_substring_regex(raw.take(pa.array(at)), HEADER).to_numpy(zero_copy_only=False)]
    kind[at] = 0
    # lines from each row's first header on
    hunk = np.cumsum(kind == 0)
    begins = np.searchsorted(row, np.arange(batch.num_rows))
    hunk_no = hunk - np.r_[0, hunk][begins][row]
    kept = np.flatnonzero(hunk_no > 0)
    row, kind, hunk, hunk_no = row[kept], kind[kept], hunk[kept] - 1, hunk_no[kept]
    first = np.searchsorted(row, row)
    out = {"row": row, "kind": kind, "hunk_no": hunk_no.astype(np.int32), "pos": (np.arange(len(row)) - first + 1).astype(np.int32)}
    # numbers of lines: counted from the header of the hunk
    numbers = _numbers(raw.take(pa.array(at)))
    head = np.flatnonzero(kind == 0)[hunk] if len(kept) else kept
    for name, values in zip(STARTS, numbers, strict=True):
        out[name] = pa.array(values[hunk].astype(np.int32), mask=values[hunk] < 0)
    for name, start, sign in (("old_line", numbers[0], 2), ("new_line", numbers[2], 1)):
        counts = np.cumsum((kind == sign) | (kind == 3))
        line = start[hunk] + counts - counts[head] - 1 if len(kept) else counts
        out[name] = pa.array(line.astype(np.int32), mask=((kind != sign) & (kind != 3)) | (start[hunk] < 0))
    # a changed line turns if the changed line before it in its hunk is of the other kind
    turn, changed = np.zeros(len(kept), bool), np.flatnonzero((kind == 1) | (kind == 2))
    turn[changed[1:]] = (kind[changed[1:]] != kind[changed[:-1]]) & (hunk[changed[1:]] == hunk[changed[:-1]])
    out["turn"] = turn
    text = raw.take(pa.array(kept))
    out["content"] = pc.if_else(pa.array(kind == 0), text, pc.utf8_slice_codeunits(text, 1))
    return out


def parse_patches(files: DataFrame) -> DataFrame:
    """One row per header, added, removed and context line: hunk_no, pos, kind, old_line, new_line, content, the header's
    old_start, old_count, new_start, new_count, and whether a changed line follows one of the other kind (turn). Positions also
    count lines of no kind, which are left out; lines before the first header have none."""
    rows = files.where("patch <> ''").select(*FILE, "filename", "status", "patch")
    schema = T.StructType([*(rows.schema[c] for c in (*FILE, "filename", "status")), *T.StructType.fromDDL("hunk_no int, pos int, kind string, old_line int, new_line int, content string, " + ", ".join(f"{c} int" for c in STARTS) + ", turn boolean").fields])
    names = np.array([*KINDS, None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("patch")).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BLOCK_BYTES, side="right")))
                part = batch.slice(low, high - low)
                found = _lines_of(part)
                known = np.flatnonzero(found["kind"] >= 0)
                at, row = pa.array(known), pa.array(found.pop("row")[known])
                found["kind"] = names[found["kind"]]
                own = {c: part.column(c).take(row) for c in (*FILE, "filename", "status")}
                own |= {c: (x if isinstance(x, pa.Array) else pa.array(x)).take(at) for c, x in found.items()}
                own["content"] = own["content"].cast(pa.string())
                yield pa.RecordBatch.from_pydict({f.name: own[f.name] for f in schema.fields})
                low = high

    return rows.mapInArrow(run, schema)


def pr_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("pr_id").agg(F.sum("additions").cast("long").alias("total_additions"), F.sum("deletions").cast("long").alias("total_deletions"), F.count("*").alias("files_changed"))


def changed_lines(lines: DataFrame) -> DataFrame:
    """New line numbers of each hunk's added lines, in order."""
    return lines.where("kind = 'added'").groupBy(*FILE, "hunk_no").agg(F.array_sort(F.collect_list("new_line")).alias("changed"))


def changed_filenames(files: DataFrame) -> DataFrame:
    return files.groupBy("pr_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "filename"))), lambda x: x["filename"]).alias("filenames"))


def split_files(text: Column) -> Column:
    """Sections of a diff of several files, one for each `diff --git` line, which an own parser run should see."""
    return F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=diff --git )"), lambda s: F.length(F.trim(s)) > 0)


def positions(comments: DataFrame, lines: DataFrame) -> DataFrame:
    """Comments (pr_id, filename, line_number, ...) with the first position of their line in the diff; the others go."""
    first = lines.where("new_line IS NOT NULL").groupBy("pr_id", "filename", F.col("new_line").alias("line_number")).agg(F.min("pos").alias("position"))
    return comments.where("line_number <> 0").join(first, ["pr_id", "filename", "line_number"])
