"""Chat-template registry (op 17) and plan-time format splitting.

Templates live in a small dimension table.  Rendering never calls
``str.format`` on data: a format is split at plan time into literal pieces
around ``{content}`` (``{stop_token}`` already substituted), and the pieces
are ``concat``-ed with the column, so inserted content is never re-scanned and
``$``/``%``/braces inside content stay literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.fixed import TEMPLATE_ROWS

TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("template_name", T.StringType(), False),
        T.StructField("system_format", T.StringType(), True),
        T.StructField("user_format", T.StringType(), True),
        T.StructField("assistant_format", T.StringType(), True),
        T.StructField("system", T.StringType(), True),
        T.StructField("stop_word", T.StringType(), True),
    ]
)


@dataclass(frozen=True)
class Template:
    template_name: str
    system_format: str | None
    user_format: str | None
    assistant_format: str | None
    system: str | None
    stop_word: str | None = None


class TemplateError(ValueError):
    """A template cannot render the requested message."""


_REGISTRY: dict[str, Template] = {}


def register_template(template_name, system_format, user_format, assistant_format, system, stop_word=None) -> Template:
    """Add or overwrite (same name) a template."""
    tpl = Template(template_name, system_format, user_format, assistant_format, system, stop_word)
    _REGISTRY[template_name] = tpl
    return tpl


for _row in TEMPLATE_ROWS:
    register_template(*_row)


def get_template(name: str) -> Template:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise TemplateError(f"unknown template {name!r}; known templates: {sorted(_REGISTRY)}") from None


def template_names() -> list[str]:
    return list(_REGISTRY)


def templates(spark: SparkSession) -> DataFrame:
    """The registry as a DataFrame (22 rows by default; small and fixed, so broadcast is safe)."""
    rows = [
        (t.template_name, t.system_format, t.user_format, t.assistant_format, t.system, t.stop_word)
        for t in _REGISTRY.values()
    ]
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


_FIELDS = ("content", "stop_token", "idx")


def split_format(fmt: str, stop_token: str | None = None, where: str = "format") -> list[str]:
    """Split a ``str.format`` string into literal pieces around ``{content}``.

    ``{stop_token}`` is substituted first; any other replacement field is an
    error (``chatglm2`` needs ``{idx}``, which no caller provides).
    """
    pieces: list[str] = []
    buf = []
    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "{" and fmt.startswith("{{", i):
            buf.append("{")
            i += 2
            continue
        if ch == "}" and fmt.startswith("}}", i):
            buf.append("}")
            i += 2
            continue
        if ch == "{":
            end = fmt.index("}", i)
            field = fmt[i + 1:end]
            if field == "content":
                pieces.append("".join(buf))
                buf = []
            elif field == "stop_token":
                if stop_token is None:
                    raise TemplateError(f"{where} needs a stop token")
                buf.append(stop_token)
            else:
                raise TemplateError(f"{where} needs field {{{field}}}, which is never supplied")
            i = end + 1
            continue
        buf.append(ch)
        i += 1
    pieces.append("".join(buf))
    return pieces


def format_column(fmt: str, content, stop_token: str | None = None, where: str = "format"):
    """Column expression equal to ``fmt.format(content=content, stop_token=stop_token)``."""
    pieces = split_format(fmt, stop_token, where)
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts.append(content)
        parts.append(F.lit(piece))
    return F.concat(*parts)


def format_literal(fmt: str, content: str, stop_token: str | None = None, where: str = "format") -> str:
    """Plan-time rendering of a constant (default system text)."""
    return content.join(split_format(fmt, stop_token, where))
