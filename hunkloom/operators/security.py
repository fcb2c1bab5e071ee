"""Secret scan of source lines and normalisation of analyzer output (Bandit, Semgrep, ruff, mypy, ESLint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import lookup, strip

# Pattern, title and rule of each kind of secret, in the order in which they are tried.
SECRETS = [
    (r"(?i)(api[_-]?key|apikey)\s*[=:]\s*['\"][A-Za-z0-9_\-]{16,}['\"]", "Possible API key", "SEC-SECRETS-001"),
    (r"(?i)(secret|password|passwd|pwd)\s*[=:]\s*['\"][^'\"]{8,}['\"]", "Hardcoded secret/password", "SEC-SECRETS-002"),
    (r"(?i)aws[_-]?(secret|access)[_-]?key\s*[=:]\s*['\"][A-Za-z0-9/+=]{20,}['\"]", "AWS credential", "SEC-SECRETS-003"),
    (r"ghp_[A-Za-z0-9]{36}", "GitHub personal access token", "SEC-SECRETS-004"),
    (r"sk-[A-Za-z0-9]{32,}", "OpenAI API key pattern", "SEC-SECRETS-005"),
    (r"(?i)bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer token in code", "SEC-SECRETS-006"),
    (r"-----BEGIN (RSA |EC |DSA )?PRIVATE KEY-----", "Private key in source", "SEC-SECRETS-007"),
]
# Words of placeholders (tried on the lower-cased line, so the two in capitals never match) and skipped suffixes.
PLACEHOLDERS = ["xxx", "placeholder", "example", "your_", "changeme", "replace_me", "<your", "TODO", "FIXME", "test", "dummy", "sample", "fake"]
SKIPPED_SUFFIXES = [".md", ".txt", ".json", ".yml", ".yaml"]


# What is said of a secret, and what to do about it.
SECRET_SAID = ("Potential secret detected: ", ". Secrets should never be committed to source control.")
SECRET_REMEDY = "Use environment variables or a secret management service. Add this file to .gitignore if it contains real credentials."


def scannable(path: Column) -> Column:
    out = ~path.endswith(SKIPPED_SUFFIXES[0])
    for s in SKIPPED_SUFFIXES[1:]:
        out &= ~path.endswith(s)
    return out


def is_placeholder(line: Column) -> Column:
    return F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda w: F.contains(F.lower(line), w))


def scan_secrets(files: DataFrame, keys: list[str], path: str = "filename", content: str = "content") -> DataFrame:
    """One row per line and pattern: texts without any match are passed by whole, of the others each line is read once, the patterns are
    unrolled into one projection."""
    any_of = "|".join(f"(?:{p})" for p, _, _ in SECRETS)  # what matches in a line matches in its text
    lines = files.where(scannable(F.col(path)) & F.col(content).rlike(any_of)).select(*keys, path, F.posexplode(F.split(content, "\n", -1)).alias("i", "line"))
    tried = F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(title).alias("title"), F.lit(rule).alias("rule_id"))) for p, title, rule in SECRETS))
    found = lines.select(*keys, path, (F.col("i") + 1).alias("line_number"), "line", F.explode(F.filter(tried, lambda s: s.isNotNull())).alias("s")).where(~is_placeholder(F.col("line")))
    return found.select(*keys, F.col(path).alias("file_path"), "line_number", F.lit("critical").alias("severity"), F.lit("medium").alias("confidence"), "s.title", F.lit("secrets").alias("tool"), "s.rule_id", F.substring(strip(F.col("line")), 1, 100).alias("code_snippet"))


def is_critical(severity: Column, confidence: Column) -> Column:
    return (severity == "critical") | ((severity == "high") & (confidence == "high"))


def blocking(findings: DataFrame, by: str) -> DataFrame:
    """Whether any finding is critical or two are high."""
    return findings.groupBy(by).agg(((F.count_if(F.col("severity") == "critical") > 0) | (F.count_if(F.col("severity") == "high") >= 2)).alias("has_blocking_issues"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "high").alias("n_high"))


def _from(text: Column, mark: str) -> Column:
    return F.when(F.locate(mark, F.col("output")) > 0, F.expr(f"substring(output, locate('{mark}', output))"))


def _relative(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"^\./", "")


_BANDIT = "struct<results:array<struct<issue_severity:string,issue_confidence:string,issue_text:string,issue_cwe:struct<id:string>,filename:string,line_number:int,test_id:string,code:string,more_info:string>>>"
_SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string,severity:string,lines:string,metadata:struct<cwe:string,impact:string,confidence:string,fix:string,references:array<string>>>>>>"
_RUFF = "array<struct<filename:string,location:struct<row:int,column:int>,code:string,message:string>>"
_ESLINT = "array<struct<filePath:string,messages:array<struct<line:int,column:int,severity:int,message:string,ruleId:string>>>>"


def parse_bandit(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of Bandit's JSON in `output`, from its first brace on; unreadable JSON gives none."""
    r = raw.select(*keys, F.explode(F.from_json(_from(F.col("output"), "{"), _BANDIT)["results"]).alias("r"))
    confidence = F.lower(F.coalesce("r.issue_confidence", F.lit("MEDIUM")))
    severity = F.when(F.col("r.issue_severity") == "HIGH", F.when(confidence == "high", "critical").otherwise("high")).when(F.col("r.issue_severity") == "LOW", "low").otherwise("medium")
    text = F.coalesce("r.issue_text", F.lit(""))
    return r.select(*keys, _relative(F.col("r.filename")).alias("file_path"), F.coalesce("r.line_number", F.lit(0)).alias("line_number"), severity.alias("severity"), confidence.alias("confidence"), text.alias("title"), F.col("r.issue_cwe.id").alias("cwe_id"), F.lit("bandit").alias("tool"), F.coalesce("r.test_id", F.lit("")).alias("rule_id"), F.substring(strip(F.coalesce("r.code", F.lit(""))), 1, 200).alias("code_snippet"), F.coalesce("r.more_info", F.lit("")).alias("remediation"))


def parse_semgrep(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of Semgrep's JSON. `cwe` may be a list or a text; a fix counts only where there are references."""
    r = raw.select(*keys, F.explode(F.from_json(_from(F.col("output"), "{"), _SEMGREP)["results"]).alias("r"))
    m = F.col("r.extra.metadata")
    cwe = m["cwe"]
    base = F.when(F.col("r.extra.severity") == "ERROR", "high").when(F.col("r.extra.severity") == "INFO", "low").otherwise("medium")
    severity = F.when((F.coalesce(m["impact"], F.lit("")) == "HIGH") | F.contains(F.lower(F.coalesce(cwe, F.lit(""))), F.lit("critical")), "critical").otherwise(base)
    first = F.when(cwe.startswith("["), F.get_json_object(cwe, "$[0]")).otherwise(F.nullif(F.substring(cwe, 1, 1), F.lit("")))
    text = F.coalesce("r.extra.message", F.lit(""))
    has = F.coalesce(F.size(m["references"]), F.lit(0)) > 0
    remedy = F.when(has, F.coalesce(F.nullif(m["fix"], F.lit("")), F.get(m["references"], 0))).otherwise(F.lit(""))
    return r.select(*keys, _relative(F.col("r.path")).alias("file_path"), F.coalesce("r.start.line", F.lit(0)).alias("line_number"), severity.alias("severity"), F.lower(F.coalesce(m["confidence"], F.lit("medium"))).alias("confidence"), F.substring(text, 1, 200).alias("title"), first.alias("cwe_id"), F.lit("semgrep").alias("tool"), F.coalesce("r.check_id", F.lit("")).alias("rule_id"), F.substring(strip(F.coalesce("r.extra.lines", F.lit(""))), 1, 200).alias("code_snippet"), remedy.alias("remediation"))


def parse_ruff(raw: DataFrame, keys: list[str]) -> DataFrame:
    r = raw.select(*keys, F.explode(F.from_json("output", _RUFF)).alias("r"))
    code = F.coalesce("r.code", F.lit(""))
    return r.select(*keys, F.coalesce("r.filename", F.lit("")).alias("file_path"), F.coalesce("r.location.row", F.lit(0)).alias("line"), F.coalesce("r.location.column", F.lit(0)).alias("column"), F.when(code.startswith("E"), "error").otherwise("warning").alias("severity"), F.coalesce("r.message", F.lit("")).alias("message"), code.alias("rule_id"), F.lit("ruff").alias("tool"))


_MYPY = r"^(.+?):(\d+):\s*(error|warning|note):\s*(.+)$"


def parse_mypy(raw: DataFrame, keys: list[str]) -> DataFrame:
    r = raw.select(*keys, F.explode(F.split("output", "\n", -1)).alias("line")).withColumn("line", strip(F.col("line"))).where(F.col("line").rlike(_MYPY))
    part = lambda k: F.regexp_extract("line", _MYPY, k)
    return r.select(*keys, part(1).alias("file_path"), part(2).cast("int").alias("line"), F.lit(0).alias("column"), F.when(part(3) == "note", "info").otherwise(part(3)).alias("severity"), part(4).alias("message"), F.lit("").alias("rule_id"), F.lit("mypy").alias("tool"))


def parse_eslint(raw: DataFrame, keys: list[str]) -> DataFrame:
    f = raw.select(*keys, F.explode(F.from_json(_from(F.col("output"), "["), _ESLINT)).alias("f"))
    r = f.select(*keys, F.coalesce("f.filePath", F.lit("")).alias("path"), F.explode("f.messages").alias("m"))
    path = F.when(F.contains("path", F.lit("/workspace/")), F.regexp_replace("path", r"^[\s\S]*?/workspace/", "")).otherwise(F.col("path"))
    return r.select(*keys, path.alias("file_path"), F.coalesce("m.line", F.lit(0)).alias("line"), F.coalesce("m.column", F.lit(0)).alias("column"), F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"), F.coalesce("m.message", F.lit("")).alias("message"), F.coalesce("m.ruleId", F.lit("")).alias("rule_id"), F.lit("eslint").alias("tool"))


def scan(files: DataFrame, bandit: DataFrame, semgrep: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of the three tools in a row, none removed."""
    columns = [*keys, "file_path", "line_number", "severity", "confidence", "title", "tool", "rule_id", "code_snippet"]
    return scan_secrets(files, keys).select(columns).unionByName(parse_bandit(bandit, keys).select(columns)).unionByName(parse_semgrep(semgrep, keys).select(columns))


def issues_for_file(issues: DataFrame, path: Column, by: str = "file_path") -> DataFrame:
    """The issues of one file, or of the file that each row names."""
    return issues.where(F.col(by) == path)


# Rule sets of every scan and of a language's.
RULESETS, LANGUAGE_RULESETS = ["p/security-audit", "p/secrets"], {"python": "p/python", "javascript": "p/javascript", "typescript": "p/javascript"}


def rulesets(language: Column) -> Column:
    own = lookup(language, LANGUAGE_RULESETS)
    return F.array_compact(F.array(*map(F.lit, RULESETS), own))


def scanners(paths: Column) -> Column:
    """The scanners that run over files: one of them only where there is Python."""
    return F.array_compact(F.array(F.lit("secrets"), F.when(has_python_files(paths), "bandit"), F.lit("semgrep")))


def scan_by_language(files: DataFrame, bandit: DataFrame, semgrep: DataFrame, keys: list[str]) -> DataFrame:
    """`scan`, with the output of the Python scanner only for groups of files that hold Python."""
    python = files.where(F.col("filename").endswith(".py")).select(*keys).distinct()
    return scan(files, bandit.join(python, keys, "left_semi"), semgrep, keys)


def analyzers(language: Column, paths: Column) -> Column:
    """The analyzers of a language: linter, type checker and tests (where there are any); others have none."""
    python = F.array_compact(F.array(F.lit("ruff"), F.lit("mypy"), F.when(has_test_files(paths), "pytest")))
    script = F.array_compact(F.array(F.lit("eslint"), F.when(F.array_contains(paths, "package.json"), "npm test")))
    return F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>"))


def analyze(groups: DataFrame, ruff: DataFrame, mypy: DataFrame, eslint: DataFrame, keys: list[str]) -> DataFrame:
    """Issues of groups of files (keys, language): only the output of their language's analyzers counts."""
    python, script = groups.where("language = 'python'").select(*keys), groups.where("language IN ('javascript', 'typescript')").select(*keys)
    parts = [parse_ruff(ruff.join(python, keys, "left_semi"), keys), parse_mypy(mypy.join(python, keys, "left_semi"), keys), parse_eslint(eslint.join(script, keys, "left_semi"), keys)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lint_counts(issues: DataFrame, by: str) -> DataFrame:
    return issues.groupBy(by).agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))


def has_python_files(paths: Column) -> Column:
    return F.exists(paths, lambda p: p.endswith(".py"))


def has_test_files(paths: Column) -> Column:
    return F.exists(paths, lambda p: F.contains(F.lower(p), F.lit("test")) | F.contains(F.lower(p), F.lit("spec")))


def run_output(stdout: Column, stderr: Column) -> Column:
    """What an analyzer's run said: both of its outputs, as far as there are any, in lines."""
    said = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", said(stdout), said(stderr))


def run_succeeded(exit_code: Column, timed_out: Column) -> Column:
    return (exit_code == 0) & ~F.coalesce(timed_out, F.lit(False))
