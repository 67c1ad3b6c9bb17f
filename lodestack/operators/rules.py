"""Rule scanners: vulnerabilities and secrets as one table of regular expressions over whole contents.

All rules are applied in one pass: an array of (rule, matches) is built for each file by built-in
expressions and exploded, so a file is read once however many rules there are, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_places, strip
from ..schemas import finding


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    severity: str
    pattern: str
    recommendation: str = ""


# Names, types, severities and patterns of the vulnerability rules, in their order.
VULNERABILITIES = [
    Rule("String format in SQL", "SQL_INJECTION", "critical", r"(?i)(execute|raw|query)\s*\([^)]*%\s*\(", "Pass values as query parameters"),
    Rule("f-string in SQL", "SQL_INJECTION", "critical", r"(?i)(execute|raw|query)\s*\(\s*f[\"']", "Pass values as query parameters"),
    Rule("String concatenation in SQL", "SQL_INJECTION", "critical", r"(?i)(execute|raw|query)\s*\([^)]*\+\s*[a-zA-Z_]", "Pass values as query parameters"),
    Rule(".format() in SQL", "SQL_INJECTION", "critical", r"(?i)(execute|raw|query)\s*\([^)]*\.format\s*\(", "Pass values as query parameters"),
    Rule("os.system with variable", "SHELL_INJECTION", "critical", r"os\.system\s*\([^)]*[+%]|os\.system\s*\(\s*f[\"']", "Run a list of arguments without a shell"),
    Rule("subprocess with shell=True", "SHELL_INJECTION", "high", r"subprocess\.(run|call|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True", "Run a list of arguments without a shell"),
    Rule("os.popen", "SHELL_INJECTION", "high", r"os\.popen\s*\(", "Run a list of arguments without a shell"),
    Rule("commands module", "SHELL_INJECTION", "high", r"commands\.(getoutput|getstatusoutput)\s*\(", "Run a list of arguments without a shell"),
    Rule("pickle.load", "UNSAFE_PICKLE", "high", r"pickle\.(load|loads)\s*\(", "Use a data-only format"),
    Rule("cPickle.load", "UNSAFE_PICKLE", "high", r"cPickle\.(load|loads)\s*\(", "Use a data-only format"),
    Rule("yaml.load without Loader", "UNSAFE_YAML_LOAD", "critical", r"yaml\.load\s*\([^)]*\)(?!.*Loader)", "Use safe_load"),
    Rule("yaml.unsafe_load", "UNSAFE_YAML_LOAD", "critical", r"yaml\.unsafe_load\s*\(", "Use safe_load"),
    Rule("shelve.open", "UNSAFE_DESERIALIZE", "medium", r"shelve\.open\s*\(", "Use a data-only format"),
    Rule("marshal.load", "UNSAFE_DESERIALIZE", "medium", r"marshal\.(load|loads)\s*\(", "Use a data-only format"),
    Rule("eval with variable", "UNSAFE_EVAL", "critical", r"eval\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[,\)]", "Use literal_eval or a parser"),
    Rule("exec with variable", "UNSAFE_EXEC", "critical", r"exec\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[,\)]", "Avoid running text as code"),
    Rule("compile with exec", "UNSAFE_EXEC", "high", r"compile\s*\([^)]*['\"]exec['\"]", "Avoid running text as code"),
    Rule("open with user input", "PATH_TRAVERSAL", "high", r"open\s*\([^)]*\+\s*[a-zA-Z_]|open\s*\(\s*f[\"']", "Resolve and check the path first"),
    Rule("os.path.join with user input", "PATH_TRAVERSAL", "medium", r"os\.path\.join\s*\([^)]*request\.|os\.path\.join\s*\([^)]*user", "Resolve and check the path first"),
    Rule("random for security", "INSECURE_RANDOM", "medium", r"random\.(random|randint|choice|shuffle|sample)\s*\(", "Use the secrets module"),
    Rule("MD5 hash", "WEAK_CRYPTO", "medium", r"(hashlib\.md5|MD5\.new)\s*\(", "Use SHA-256 or better"),
    Rule("SHA1 hash", "WEAK_CRYPTO", "medium", r"(hashlib\.sha1|SHA\.new)\s*\(", "Use SHA-256 or better"),
    Rule("DES encryption", "WEAK_CRYPTO", "high", r"(DES\.new|DES3\.new)\s*\(", "Use AES"),
    Rule("SSL verification disabled", "DISABLED_CERT_VERIFICATION", "high", r"verify\s*=\s*False", "Leave certificates verified"),
    Rule("Insecure SSL context", "INSECURE_SSL", "high", r"ssl\.CERT_NONE", "Leave certificates verified"),
    Rule("SSLv2/SSLv3", "INSECURE_SSL", "critical", r"ssl\.(PROTOCOL_SSLv2|PROTOCOL_SSLv3)", "Use TLS 1.2 or later"),
]

SECRETS = [
    Rule("AWS access key", "HARDCODED_API_KEY", "critical", r"\bAKIA[0-9A-Z]{16}\b", "Read it from the environment"),
    Rule("AWS secret key", "HARDCODED_SECRET", "critical", r"(?i)aws_secret_access_key\s*=\s*[\"'][A-Za-z0-9/+=]{40}[\"']", "Read it from the environment"),
    Rule("Google API key", "HARDCODED_API_KEY", "high", r"\bAIza[0-9A-Za-z_\-]{35}\b", "Read it from the environment"),
    Rule("Stripe key", "HARDCODED_API_KEY", "critical", r"\bsk_live_[0-9a-zA-Z]{16,}\b", "Read it from the environment"),
    Rule("GitHub token", "HARDCODED_TOKEN", "critical", r"\bghp_[0-9A-Za-z]{36}\b", "Read it from the environment"),
    Rule("Database URL", "HARDCODED_PASSWORD", "high", r"\b[a-z][a-z0-9+]*://[^\s:/@\"']+:[^\s:/@\"']+@", "Read it from the environment"),
    Rule("Private key", "HARDCODED_CRYPTO_KEY", "critical", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", "Keep keys out of the source"),
    Rule("Password", "HARDCODED_PASSWORD", "high", r"(?i)\b\w*password\s*[=:]\s*[\"'][^\"']{4,}[\"']", "Read it from the environment"),
    Rule("API key", "HARDCODED_API_KEY", "high", r"(?i)\b\w*api_?key\s*[=:]\s*[\"'][^\"']{4,}[\"']", "Read it from the environment"),
    Rule("Secret or token", "HARDCODED_SECRET", "high", r"(?i)\b\w*(secret|token)\s*[=:]\s*[\"'][^\"']{4,}[\"']", "Read it from the environment"),
]


def _hits(rule: Rule, content: Column) -> Column:
    """The rule's matches in a content as (rule fields, line number)."""
    hit = lambda m: F.struct(F.lit(rule.name).alias("name"), F.lit(rule.type).alias("type"), F.lit(rule.severity).alias("severity"), F.lit(rule.recommendation).alias("recommendation"), m["line_number"].alias("line"))
    return F.when(content.rlike(rule.pattern), F.transform(match_places(content, rule.pattern), hit))


def scan(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """findings of all rules over whole contents; a match's line is that of its start, and comment lines are skipped."""
    content = F.col("content")
    hits = F.flatten(F.filter(F.array(*(_hits(r, content) for r in rules)), lambda x: x.isNotNull()))
    rows = files.where(F.lit(False) if not rules else _any(content, rules)).select("path", hits.alias("hits"), F.split(content, "\n", -1).alias("lines"))
    text = F.transform("hits", lambda h: F.struct(h.alias("h"), strip(F.element_at(F.col("lines"), h["line"])).alias("text")))
    rows = rows.select("path", F.explode(F.filter(text, lambda x: ~x["text"].startswith("#"))).alias("x"))
    h = F.col("x.h")
    return rows.select(*finding("security", h["type"], file_path=F.col("path"), line_number=h["line"], name=h["name"], message=F.concat(h["name"], F.lit(" found")), severity=h["severity"], code_snippet=F.substring(F.col("x.text"), 1, 100), recommendation=h["recommendation"]))


def _any(content: Column, rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | content.rlike(r.pattern)
    return out


def vulnerabilities(files: DataFrame, *types: str, name_contains: str = "") -> DataFrame:
    """All vulnerability rules, or those of some types, or those whose name has a word."""
    return scan(files, [r for r in VULNERABILITIES if (not types or r.type in types) and name_contains in r.name.lower()])


def secrets(files: DataFrame, extra: list[Rule] | None = None) -> DataFrame:
    return scan(files, SECRETS + (extra or []))


def security_findings(files: DataFrame) -> DataFrame:
    return scan(files, SECRETS + VULNERABILITIES)
