"""Operators written as one SQL statement over named frames.

The text names its input frames and parameters in braces.  A few capitalised
macros stand for what dialects spell differently, so that the same statement
can be checked by a second engine; ``duck`` overrides it where the
two differ by more, or where an independent formulation is a better check.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomery.errors import BadRequest

_SPARK = {
    "SECS": "unix_seconds(CAST({0} AS TIMESTAMP))",
    "BUCKET": "(CAST(conv(substring(sha2(CAST({0} AS STRING), 256), 1, 8), 16, 10) AS BIGINT) % {1})",
    "HASH": "CAST(conv(substring(sha2(CAST({0} AS STRING), 256), 1, 8), 16, 10) AS BIGINT)",
    "SHA": "sha2(CAST({0} AS STRING), 256)",
    "SERIES": "explode(sequence({0}, {1}))",
    "LIST": "array_sort(collect_list({0}))",
    "SET": "array_sort(collect_set({0}))",
    "JOINED": "array_join({0}, {1})",
    "SIZE": "size({0})",
    "INT": "CAST(floor({0}) AS BIGINT)",
    "TOTAL": "CAST(sum({0}) AS BIGINT)",
    "TEXT": "CAST({0} AS STRING)",
    "XOR": "({0} ^ {1})",
    "RSHIFT": "shiftright({0}, {1})",
    "MODE_ROWS": "VALUES {0}",
}
_DUCK = {
    "SECS": "CAST(floor(epoch({0})) AS BIGINT)",
    "BUCKET": "(CAST(CAST(concat('0x', substr(sha256(CAST({0} AS VARCHAR)), 1, 8)) AS UBIGINT) AS BIGINT) % {1})",
    "HASH": "CAST(CAST(concat('0x', substr(sha256(CAST({0} AS VARCHAR)), 1, 8)) AS UBIGINT) AS BIGINT)",
    "SHA": "sha256(CAST({0} AS VARCHAR))",
    "SERIES": "unnest(generate_series({0}, {1}))",
    "LIST": "list_sort(list({0}))",
    "SET": "list_sort(list(DISTINCT {0}))",
    "JOINED": "array_to_string({0}, {1})",
    "SIZE": "len({0})",
    "INT": "CAST(floor({0}) AS BIGINT)",
    "TOTAL": "CAST(sum({0}) AS BIGINT)",
    "TEXT": "CAST({0} AS VARCHAR)",
    "XOR": "xor({0}, {1})",
    "RSHIFT": "({0} >> {1})",
    "MODE_ROWS": "VALUES {0}",
}
_NAME = re.compile(r"\b(" + "|".join(_SPARK) + r")\(")


def _expand(text: str, table: dict[str, str]) -> str:
    """Replace macros, innermost last, minding nested parentheses and quotes."""
    while m := _NAME.search(text):
        depth, at, args, start, quoted = 1, m.end(), [], m.end(), False
        while depth:
            c = text[at]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 1:
                    args.append(text[start:at].strip())
                    start = at + 1
            at += 1
        args.append(text[start : at - 1].strip())
        body = table[m[1]]
        for k, arg in enumerate(args):
            body = body.replace("{" + str(k) + "}", arg)
        text = text[: m.start()] + body + text[at:]
    return text


@dataclass(frozen=True)
class SqlOperator:
    """``sql`` over ``{frame}`` names; ``params`` are literal defaults for ``{name}``."""

    sql: str
    params: dict[str, object] = field(default_factory=dict)
    duck: str | None = None

    def frames(self) -> list[str]:
        names = dict.fromkeys(re.findall(r"\{([a-z_]+)\}", self.sql + (self.duck or "")))
        return [n for n in names if n not in self.params]

    def _bound(self, text: str, changes: dict[str, object]) -> str:
        for name, value in {**self.params, **changes}.items():
            text = text.replace("{" + name + "}", str(value))
        return text

    def spark_sql(self, **changes: object) -> str:
        if unknown := set(changes) - set(self.params):
            raise BadRequest(f"no such parameters: {sorted(unknown)}")
        return _expand(self._bound(self.sql, changes), _SPARK)

    def apply(self, spark: SparkSession, frames: dict[str, DataFrame], **changes: object) -> DataFrame:
        text = self.spark_sql(**changes)
        used = {n: frames[n] for n in self.frames() if "{" + n + "}" in text}
        return spark.sql(text, **used)

    def duck_sql(self, views: dict[str, str]) -> str:
        """The statement for the second engine; ``views`` gives the SQL of frames that are not tables."""
        text = _expand(self._bound(self.duck or self.sql, {}), _DUCK)
        used = [n for n in self.frames() if "{" + n + "}" in text]
        for n in used:
            text = text.replace("{" + n + "}", n)
        heads = ", ".join(f"{n} AS ({views[n]})" for n in used if n in views)
        if not heads:
            return text
        body = text.strip()
        if body.upper().startswith("WITH RECURSIVE"):
            return f"WITH RECURSIVE {heads}, {body[14:]}"
        return f"WITH {heads}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
