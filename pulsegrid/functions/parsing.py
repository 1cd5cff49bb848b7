"""Raw log lines to LOG_ENTRY rows, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field aliases in order of preference.
JSON_LEVEL = ("level", "lvl", "severity")
JSON_MESSAGE = ("message", "msg", "text")
JSON_TIME = ("time", "timestamp", "ts")
LOGFMT_LEVEL = ("level", "lvl", "severity")
LOGFMT_MESSAGE = ("msg", "message", "text")
LOGFMT_TIME = ("time", "ts", "timestamp", "at")
LOGFMT_LATENCY = ("latency", "latency_ms", "duration", "elapsed")

# Keyword to level for plain text, first match wins.
PLAINTEXT_LEVELS = (
    (("CRITICAL", "FATAL"), "CRITICAL"),
    (("ERROR",), "ERROR"),
    (("WARN", "WARNING"), "WARNING"),
    (("INFO",), "INFO"),
    (("DEBUG",), "DEBUG"),
)

# Fixed value: a logfmt pair, quoted (group 2) or bare (group 3).
LOGFMT_PAIR = r'(?U)(\w+)=(?:"((?:[^"\\]|\\.)*)"|(\S*))'

# All white space, as str.strip knows it.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + \
    "\u2028\u2029\u202f\u205f\u3000"
# Line ends that Python's splitlines knows beyond those of Spark's text reader.
_LINE_END = r"[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_T_FORM = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})$"
_SPACE_FORM = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_SPACE_FRACTION_FORM = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$"


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(text, F.lit(_WHITE))


def parse_timestamp(text: Column, space_fraction: bool = False) -> Column:
    """ISO time with zone, or `date time` taken as UTC; null when it is neither.

    External tables may carry a fraction in the second form (`space_fraction`).
    """
    known = text.rlike(_T_FORM) | text.rlike(_SPACE_FRACTION_FORM if space_fraction else _SPACE_FORM)
    return F.when(known, F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def plaintext_level(line: Column) -> Column:
    """The first keyword present as a word, in any case; the plain search spares most lines the pattern."""
    upper, pick = F.upper(line), F.lit("UNKNOWN")
    for words, level in reversed(PLAINTEXT_LEVELS):
        found = upper.rlike(rf"(?U)\b({'|'.join(words)})\b")
        for word in words:
            pick = F.when(upper.contains(word) & found, level).otherwise(pick)
    return pick


def _truthy_text(value: Column) -> Column:
    """A JSON value as text, or null where it is empty, zero, false or null."""
    kind = F.schema_of_variant(value)
    text = value.try_cast("string")
    numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    empty = (
        kind.isNull() | (kind == "VOID")
        | ((kind == "STRING") & (text == ""))
        | ((kind == "BOOLEAN") & (text == "false"))
        | (numeric & (text.try_cast("double") == 0))
        | (kind.startswith("ARRAY") & (text == "[]"))
        | (kind.startswith("OBJECT") & (text == "{}"))
    )
    return F.when(~empty, F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))


# Texts that mean different things as JSON strings and as other JSON values.
_AMBIGUOUS = r"^(true|false|-?0+(\.0*)?([eE].*)?|\[\]|\{\})$"


def _typed_text(line: Column, fields: Column, key: str) -> Column:
    """A field as text, null where it is falsy; types are looked at only where they matter."""
    text = fields[key]
    typed = F.from_json(line, "map<string,variant>", {"allowSingleQuotes": "false"})[key]
    return F.when(text.rlike(_AMBIGUOUS), _truthy_text(typed)).otherwise(F.nullif(text, F.lit("")))


def _json_document(line: Column) -> Column:
    """The line as an array of one object; null for anything else.

    The line is read as the only element of an array, so trailing text is an error.
    """
    return F.from_json(
        F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"}
    )


def _json_fields(document: Column) -> Column:
    # Rebuilding the map keeps the last of repeated keys (mapKeyDedupPolicy).
    return F.when(F.size(document) == 1, F.map_from_entries(F.map_entries(document[0])))


def _is_other_json(line: Column) -> Column:
    """Valid JSON that is no object: an array or a single value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    return F.coalesce(F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 1, F.lit(False))


def _logfmt_fields(line: Column) -> Column:
    part = lambda group: F.regexp_extract_all(line, F.lit(LOGFMT_PAIR), F.lit(group))
    return F.map_from_arrays(part(1), F.zip_with(part(2), part(3), lambda quoted, bare: F.concat(quoted, bare)))


def _present(fields: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[fields[k] for k in keys])


def _suffix_free(text: Column) -> Column:
    """Drop any trailing run of the letters m and s, then read a number."""
    return F.rtrim(text, F.lit("ms")).try_cast("double")


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Turn raw lines into LOG_ENTRY rows.

    Needs `line, log_format, latency_field, source_id, tenant_id, service_name,
    environment, ingest_ts`; further columns pass through. Blank lines and JSON
    that is no object are dropped; text that fails its format is plain text.
    """
    fixed = {"line", "log_format", "latency_field", "source_id", "tenant_id", "service_name",
             "environment", "ingest_ts"}
    extra = [c for c in lines.columns if c not in fixed]
    split = lines.withColumn("line", F.explode(F.split("line", _LINE_END)))
    rows = split.withColumn("line", strip(F.col("line"))).filter("line <> ''")

    line, want, log_format = F.col("line"), F.nullif(F.col("latency_field"), F.lit("")), F.col("log_format")
    # Exploding an array of one keeps the optimizer from parsing a line again for every use.
    rows = rows.withColumn("_document", F.explode(F.array(F.when(log_format == "json", _json_document(line)))))
    document = F.col("_document")
    other = F.when(document.isNull(), _is_other_json(line)).otherwise(
        (F.size(document) == 1) & document[0].isNull())
    dropped = (log_format == "json") & other
    rows = rows.filter(~F.coalesce(dropped, F.lit(False))).withColumns({
        "_json": _json_fields(document),
        "_pairs": F.when(log_format == "logfmt", _logfmt_fields(line)),
    })

    obj, pairs = F.col("_json"), F.col("_pairs")
    is_json, is_logfmt = obj.isNotNull(), F.coalesce(F.size(pairs) > 0, F.lit(False))
    truthy = lambda keys: F.coalesce(*[_typed_text(line, obj, k) for k in keys])
    auto_latency = F.coalesce(*[_suffix_free(pairs[k]) for k in LOGFMT_LATENCY])

    def by_format(json: Column, logfmt: Column, plain: Column) -> Column:
        return F.when(is_json, json).when(is_logfmt, logfmt).otherwise(plain)

    level = by_format(truthy(JSON_LEVEL), _present(pairs, LOGFMT_LEVEL), plaintext_level(line))
    message = by_format(truthy(JSON_MESSAGE), _present(pairs, LOGFMT_MESSAGE), line)
    seen = by_format(truthy(JSON_TIME), _present(pairs, LOGFMT_TIME), F.lit(None).cast("string"))
    latency = by_format(
        obj[want].try_cast("double"),
        F.when(want.isNotNull(), _suffix_free(pairs[want])).otherwise(auto_latency),
        F.lit(None).cast("double"),
    )
    raw = by_format(
        obj, pairs, F.create_map(F.lit("raw_line"), line)
    )
    return rows.select(
        F.coalesce(parse_timestamp(seen), F.col("ingest_ts")).alias("occurred_at"),
        upper_level(level).alias("level"),
        F.coalesce(message, line).alias("message"),
        "source_id", "tenant_id", "service_name", "environment",
        latency.alias("latency_ms"),
        raw.alias("raw"),
        *extra,
    )


def upper_level(level: Column) -> Column:
    return F.coalesce(F.upper(F.nullif(level, F.lit(""))), F.lit("UNKNOWN"))
