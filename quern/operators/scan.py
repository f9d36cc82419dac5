"""Content scanning of texts and files: rule tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, words and signatures of the rules.
PATTERNS = {
    "general": (r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"data:text/html", r"eval\s*\(", r"exec\s*\(", r"system\s*\(", r"shell_exec\s*\(", r"passthru\s*\(", r"base64_decode\s*\("),
    "office": (r"ActiveXObject", r"WScript\.Shell", r"Shell\.Application", r"CreateObject", r"GetObject", r"<%.*?%>", r"<\?.*?\?>"),
    "pdf": (r"/JavaScript", r"/JS", r"/OpenAction", r"/Launch", r"/EmbeddedFile", r"/URI\s*\("),
    "text": (r"rm\s+-rf\s+/", r"format\s+c:", r"del\s+/s\s+/q", r"DROP\s+DATABASE", r"DELETE\s+FROM.*WHERE.*1=1"),
}
BASIC = ("<script", "javascript:", "vbscript:", "data:text/html", "<?php", "<%", "eval(", "exec(", "system(", "shell_exec(")
KEYWORDS = ("password", "secret", "private_key", "api_key", "token", "malware", "virus", "trojan", "backdoor", "exploit", "inject", "payload", "shellcode")
DANGEROUS = ("4D5A", "504B0304", "7F454C46", "CAFEBABE", "FEEDFACE", "FEEDFACF")
SIGNATURES = (
    ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("D0CF11E0", "application/msword"), ("7B5C7274", "application/rtf"), ("EFBBBF", "text/plain"), ("FFFE", "text/plain"), ("FEFF", "text/plain"),
    ("FFD8FF", "image/jpeg"), ("89504E47", "image/png"), ("4D5A", "application/x-executable"), ("7F454C46", "application/x-executable"), ("CAFEBABE", "application/x-executable"),
    ("23212F62696E2F7368", "text/x-shellscript"), ("23212F62696E2F62617368", "text/x-shellscript"), ("3C3F706870", "application/x-php"), ("3C736372697074", "text/html"),
)
EXTENSIONS = (("txt", "text/plain"), ("md", "text/markdown"), ("csv", "text/csv"), ("json", "application/json"), ("html", "text/html"), ("xml", "application/xml"), ("pdf", "application/pdf"), ("doc", "application/msword"), ("rtf", "application/rtf"))
ALLOWED = {"txt": ("text/plain",), "pdf": ("application/pdf",), "doc": ("application/msword",), "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), "rtf": ("application/rtf", "text/rtf"), "odt": ("application/vnd.oasis.opendocument.text",), "md": ("text/markdown", "text/x-markdown"), "json": ("application/json",), "csv": ("text/csv",), "xml": ("application/xml", "text/xml")}
SHORT_OR_LOCAL = ("bit.ly", "tinyurl.com", "goo.gl", "t.co", "localhost", "127.0.0.1", "0.0.0.0")
URL = r"(?i)https?://[^\s<>\"']*"
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{n}{i}" for n in ("COM", "LPT") for i in range(1, 10)))
ACTIVE = {"pdf": ("/JavaScript", "/JS", "/OpenAction", "/Launch", "/EmbeddedFile", "/URI", "/GoToR", "/ImportData"), "office": ("vbaProject", "macros/", "VBA", "ActiveXObject", "WScript", "Shell.Application"), "xml": ("<!ENTITY", "SYSTEM", "file://", "<!DOCTYPE")}
MAX_BYTES = 50 << 20


def _found(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(ok, F.lit(name)) for ok, name in rules)))


def scan_patterns(text: Column, kinds: tuple[str, ...] = ("general", "text"), limit: int = 1 << 20) -> Column:
    """The patterns found in the first characters."""
    head = F.substring(text, 1, limit)
    return _found([(head.rlike(f"(?is){p}"), p) for k in kinds for p in PATTERNS[k]])


def scan_patterns_basic(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 10_240))
    return _found([(F.contains(head, F.lit(p)), p) for p in BASIC])


def scan_keywords(text: Column) -> Column:
    return _found([(F.contains(F.lower(text), F.lit(w)), w) for w in KEYWORDS])


def byte_entropy(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, entropy): Shannon entropy of the UTF-8 bytes, by counts of two hex digits."""
    hexed = F.hex(F.encode(F.col(text), "UTF-8"))
    each = docs.select("doc_id", F.explode(F.regexp_extract_all(hexed, F.lit("[0-9A-F]{2}"), F.lit(0))).alias("b"))
    per = each.groupBy("doc_id", "b").agg(F.count("*").alias("n"))
    total = per.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select("doc_id", (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def extract_urls(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(URL), F.lit(0))).alias("url"))


def suspicious_urls(urls: DataFrame) -> DataFrame:
    """Distinct (doc_id, url) of shorteners, local hosts, addresses, long names and special characters in the host."""
    low = F.lower("url")
    host = F.regexp_extract(low, r"^https?://([^/?#]*)", 1)
    bad = host.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|[a-z0-9]{20,}\.com|[^a-z0-9.-]")
    for d in SHORT_OR_LOCAL:
        bad = bad | F.contains(low, F.lit(d))
    return urls.filter(bad).distinct()


def detect_type(content: Column, name: Column) -> Column:
    """struct<mime, confidence>: by first bytes 0.9, by extension 0.7, else octet-stream 0.3."""
    head = F.hex(F.substring(content, 1, 32))
    found = F.lit(None).cast("string")
    for sig, mime in reversed(SIGNATURES):
        found = F.when(head.startswith(sig), mime).otherwise(found)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    guess = F.lit(None).cast("string")
    for e, mime in EXTENSIONS:
        guess = F.when(ext == e, mime).otherwise(guess)
    return F.struct(F.coalesce(found, guess, F.lit("application/octet-stream")).alias("mime"), F.when(found.isNotNull(), 0.9).when(guess.isNotNull(), 0.7).otherwise(0.3).alias("confidence"))


def detect_bom(content: Column) -> Column:
    """struct<encoding, bom, confidence> from the first 8 KB."""
    head = F.hex(F.substring(content, 1, 4))
    bom = F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be")
    valid = F.is_valid_utf8(F.substring(content, 1, 8192))
    return F.struct(F.coalesce(bom, F.when(valid, "utf-8").otherwise("latin-1")).alias("encoding"), bom.isNotNull().alias("bom"), F.when(bom.isNotNull(), 0.9).when(valid, 0.7).otherwise(0.5).alias("confidence"))


def sanitized_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, 255)


def title_of(name: Column) -> Column:
    return F.initcap(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "))


def validate_filenames(files: DataFrame, name: str = "name") -> DataFrame:
    """error, sanitized and title of file names."""
    n = F.coalesce(F.col(name), F.lit(""))
    base = F.upper(F.split_part(n, F.lit("."), F.lit(1)))
    error = F.when(n == "", "empty").when(F.length(n) > 255, "too long").when(n.rlike(r'\.\.|[/\\<>:"|?*]'), "dangerous character").when(base.isin(*RESERVED), "reserved name")
    return files.withColumn("error", error).withColumn("sanitized", sanitized_name(n)).withColumn("title", title_of(n))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def validate_files_basic(files: DataFrame) -> DataFrame:
    """errors and sha256 of files (name, content): name, extension, size and first bytes."""
    own = validate_filenames(files)
    size, head = F.octet_length("content"), F.hex(F.substring("content", 1, 8))
    rules = [(F.col("error").isNotNull(), "name"), (~extension(F.col("name")).isin(*ALLOWED), "extension"), (size == 0, "empty"), (size > MAX_BYTES, "too large"), (F.lit(False), "")]
    rules += [(head.startswith(s), f"signature {s}") for s in DANGEROUS]
    return own.withColumn("errors", _found(rules)).withColumn("sha256", F.sha2("content", 256))


def validate_files(files: DataFrame) -> DataFrame:
    """errors of files (name, content): the basic rules, the detected type against the extension, and the content scan."""
    own = validate_files_basic(files).withColumn("_type", detect_type(F.col("content"), F.col("name")))
    known = F.lit(False)
    for e, mimes in ALLOWED.items():
        known = known | ((extension(F.col("name")) == e) & F.col("_type.mime").isin(*mimes))
    text = F.decode("content", "ISO-8859-1")
    more = _found([(~known, "type"), (F.size(scan_patterns(text)) > 0, "content")])
    return own.withColumn("errors", F.concat("errors", more)).drop("_type")


def check_active_content(text: Column, kind: str) -> Column:
    return _found([(F.contains(text, F.lit(p)), p) for p in ACTIVE[kind]])
