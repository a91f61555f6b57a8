"""Scalar functions: quoting, redaction, names, retry classes and waits, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: What redaction looks for and puts there, in this order. White space is that of the patterns' own language,
#: which has no vertical tab; letters match in either case, also beyond ASCII.
REDACTIONS = (
    (r"(?i)(authorization)\s*[:=]\s*Bearer\s+\S+", "$1=Bearer [REDACTED]"),
    (r"(?i)(password|passwd|pwd|secret|token|dsn)\s*[:=]\s*[^\s,;'\"]+", "$1=[REDACTED]"),
    (r"(?i)Bearer\s+\S+", "Bearer [REDACTED]"),
    (r"ENC~[A-Za-z0-9+/=_-]+", "ENC~[REDACTED]"),
)
#: Keys whose values are hidden in the details of events, and what stands instead.
SENSITIVE_KEYS = ("password", "passwd", "pwd", "secret", "token", "authorization", "dsn", "connection_string")
HIDDEN = "[REDACTED]"
#: What tells errors that may be tried again, by what was done.
RETRYABLE = {
    "read": ("invalid connection", "bad connection", "connection refused", "broken pipe", "connection reset", "connection was bad", "lock wait timeout", "try restarting transaction", "server shutdown", "lost connection", "unexpected eof", "unexpected packet"),
    "write": ("deadlock", "lock wait timeout", "try restarting transaction"),
    "connection": ("invalid connection", "bad connection", "unexpected packet", "connection was bad", "connection refused", "broken pipe", "connection reset"),
    "cursor": ("invalid connection", "bad connection", "unexpected packet", "connection was bad"),
}
#: The same for locks of index builds, upper and lower case told apart.
RETRYABLE_LOCKS = ("Error 1205", "Error 1213", "Lock wait timeout", "Deadlock found")
#: Sink options that hold secrets, and what an answer shows instead.
SECRET_OPTIONS, MASK = ("sasl_password",), "******"
#: Names of locks and staging tables, and the longest name.
LOCK_PREFIX, STAGING_PREFIX, SHORT_STAGING_PREFIX, LONGEST_NAME = "mts_fl_v2:", "__mts_staging_", "__mts_s_", 64


def quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def redacted(text: Column) -> Column:
    for pattern, new in REDACTIONS:
        java = pattern.replace("(?i)", "(?iu)").replace(r"[^\s,", r"[^\t\n\f\r ,").replace(r"\s", r"[\t\n\f\r ]").replace(r"\S", r"[^\t\n\f\r ]")
        text = F.regexp_replace(text, java, new)
    return text


def masked(value: Column, kind: DataType) -> Column:
    """Details of an event, of any nesting of structs, maps and arrays, without secrets: values of sensitive keys hidden, all
    other text redacted. Elements of arrays are redacted if they are text and searched if they have keys."""
    if isinstance(kind, StructType):
        out = F.struct(*[(F.lit(HIDDEN) if f.name.lower() in SENSITIVE_KEYS else masked(value[f.name], f.dataType)).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), out)
    if isinstance(kind, MapType):
        hide = lambda k, v: masked(v, kind.valueType) if not isinstance(kind.valueType, StringType) else F.when(F.lower(k).isin(*SENSITIVE_KEYS), HIDDEN).otherwise(redacted(v))
        return F.transform_values(value, hide)
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, ArrayType):
        return F.transform(value, lambda x: masked(x, kind.elementType))
    return redacted(value) if isinstance(kind, StringType) else value


def shown_options(options: Column) -> Column:
    """A map of sink options as an answer shows it."""
    return F.transform_values(options, lambda k, v: F.when(k.isin(*SECRET_OPTIONS) & (v != ""), MASK).otherwise(v))


def lock_name(schema: Column, prefix: str = LOCK_PREFIX, most: int = LONGEST_NAME) -> Column:
    """prefix + schema, or if too long prefix + 27 bytes of its SHA-256 in hex."""
    return F.when(F.length(schema) + len(prefix) <= most, F.concat(F.lit(prefix), schema)).otherwise(F.concat(F.lit(prefix), F.substring(F.sha2(schema.cast("binary"), 256), 1, 54)))


def staging_name(table_name: Column, attempt: Column, most: int = LONGEST_NAME) -> Column:
    """Lengths are in bytes; a name that is too long gives way to 8 bytes of its SHA-256 under a prefix of its own."""
    name = F.concat(F.lit(STAGING_PREFIX), table_name, F.lit("_"), attempt.cast("string"))
    short = F.concat(F.lit(SHORT_STAGING_PREFIX), F.substring(F.sha2(table_name.cast("binary"), 256), 1, 16), F.lit("_"), attempt.cast("string"))
    return F.when(F.octet_length(name) <= most, name).otherwise(short)


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def retryable(message: Column, doing: str = "read") -> Column:
    return _contains_any(F.lower(message), RETRYABLE[doing])


def retryable_lock(message: Column) -> Column:
    return _contains_any(message, RETRYABLE_LOCKS)


def key_text(value: Column) -> Column:
    """A key's value as text; null is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def index_columns(columns: Column) -> Column:
    """Names in a list of index parts: what stands between backquotes, else what stands before a bracket."""
    parts = F.filter(F.transform(F.split(columns, ","), lambda p: F.trim(p)), lambda p: p != "")
    plain = lambda p: F.trim(F.substring_index(p, "(", 1))
    return F.transform(parts, lambda p: F.when(p.rlike("`[^`]*`"), F.regexp_extract(p, "`([^`]*)`", 1)).otherwise(plain(p)))


def same_columns(columns: Column, wanted: Column) -> Column:
    """Whether the index parts are these columns in this order, in either case; no columns wanted match nothing."""
    low = lambda names: F.transform(names, F.lower)
    return (F.size(wanted) > 0) & (low(index_columns(columns)) == low(wanted))


def backoff(attempt: Column, base_ms: float, factor: float, most_ms: float) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(factor), attempt.cast("double")), F.lit(most_ms))


def duration(seconds: Column) -> Column:
    """h, m and s, without leading parts that are 0."""
    h, m, s = F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), (seconds % 60).cast("long")
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat(text(h, "h"), text(m, "m"), text(s, "s"))).when(m > 0, F.concat(text(m, "m"), text(s, "s"))).otherwise(text(s, "s"))


def _key(key: str) -> Column:
    """32 bytes: cut or padded with zeros."""
    return F.lit(bytearray(key.encode()[:32].ljust(32, b"\0")))


def sealed(value: Column, key: str) -> Column:
    """AES-256-GCM: a mark, then nonce, cipher text and tag in Base64."""
    return F.concat(F.lit("ENC~"), F.regexp_replace(F.base64(F.aes_encrypt(value.cast("binary"), _key(key), F.lit("GCM"))), r"[\r\n]", ""))


def opened(value: Column, key: str) -> Column:
    """What was sealed; text without the mark as it is."""
    return F.when(value.startswith("ENC~"), F.aes_decrypt(F.unbase64(F.substr(value, F.lit(5))), _key(key), F.lit("GCM")).cast("string")).otherwise(value)
