"""SQL names for the scalar functions, whose bodies are SQL expressions that inline into the plan, and for the strings of a binary value."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from outfall.functions.ship import by_value
from outfall.operators.extract import ASCII_RUN, WIDE_RUN

PREFIX = "outfall_"
_ASCII, _WIDE = re.compile(ASCII_RUN.encode()), re.compile(WIDE_RUN.encode())
SAFE = r"[A-Za-z0-9._~!$&\'()*+,;=:/-]"

FUNCTIONS = {
    "entropy(v STRING) RETURNS DOUBLE": """
      CASE WHEN length(v) = 0 THEN 0D ELSE -aggregate(transform(array_distinct(split(v, '')), c -> (length(v) - length(replace(v, c, ''))) / CAST(length(v) AS DOUBLE)),
      0D, (a, p) -> a + p * log2(p)) END""",
    "mask(v STRING) RETURNS STRING": """
      CASE WHEN length(v) <= 12 THEN repeat('•', length(v)) ELSE concat(left(v, 4), repeat('•', least(length(v) - 8, 12)), right(v, 4)) END""",
    "finding_id(rule STRING, vhash STRING, path STRING, at BIGINT) RETURNS STRING": """
      substring(sha2(concat_ws(chr(31), rule, vhash, path, CAST(coalesce(at, 0) AS STRING)), 256), 1, 32)""",
    "severity_rank(s STRING) RETURNS INT": """
      CASE s WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END""",
    "purl_quote(v STRING) RETURNS STRING": f"""
      array_join(transform(split(v, ''), c -> CASE WHEN c = '' OR c RLIKE '^{SAFE}$' THEN c ELSE regexp_replace(hex(encode(c, 'UTF-8')), '(..)', '%$1') END), '')""",
    "purl(ecosystem STRING, name STRING, version STRING) RETURNS STRING": f"""
      concat('pkg:', ecosystem, '/',
        CASE WHEN ecosystem = 'npm' AND startswith(name, '@') AND contains(name, '/') THEN concat({PREFIX}purl_quote(substring_index(name, '/', 1)), '/', {PREFIX}purl_quote(regexp_replace(name, '^[^/]*/', '')))
             WHEN ecosystem = 'golang' AND contains(name, '/') THEN concat({PREFIX}purl_quote(regexp_replace(name, '/[^/]*$', '')), '/', {PREFIX}purl_quote(substring_index(name, '/', -1)))
             ELSE {PREFIX}purl_quote(name) END,
        CASE WHEN version <> '' THEN concat('@', {PREFIX}purl_quote(version)) ELSE '' END)""",
    "mask_secretish(v STRING) RETURNS STRING": """
      regexp_replace(v, '([A-Za-z0-9+/=_-]{4})[A-Za-z0-9+/=_-]{12,}([A-Za-z0-9+/=_-]{4})', '$1••••••••••••$2')""",
}


@udtf(returnType="value string, byte_offset bigint, encoding string", useArrow=False)
class Strings:
    """Strings of a binary value, both encodings, in time that grows with its size.

    A table function, since Spark's Arrow table functions cannot stand in a lateral join; a null value gives none.
    """

    def eval(self, content: bytes | None):
        data = bytes(content) if content is not None else b""
        for m in _ASCII.finditer(data):
            yield m.group().decode("ascii"), m.start(), "ascii"
        if b"\0" in data:
            for m in _WIDE.finditer(data):
                yield m.group()[::2].decode("ascii"), m.start(), "utf-16le"


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    names = []
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{signature} RETURN {body}")
        names.append(PREFIX + signature.split("(")[0])
    spark.udtf.register(f"{PREFIX}strings", Strings)
    names.append(f"{PREFIX}strings")
    return names


by_value(__name__)
