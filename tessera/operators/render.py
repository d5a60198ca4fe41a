"""Template rendering (ops 18-23).

All rendering is ``transform``/``concat`` over the nested conversation
column: one narrow stage, no shuffle, no Python.  Formats are split into
literal pieces at plan time (see ``functions.templates``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col
from tessera.functions.fixed import CHAT_DEFAULT_SYSTEM_BLOCK, CHAT_GENERATION_PROMPT, EOS_TOKEN, IM_END, IM_START
from tessera.functions.templates import Template, TemplateError, format_column, format_literal, get_template

MESSAGE_FIELDS = ("role", "text")


def _tpl(template) -> Template:
    return template if isinstance(template, Template) else get_template(template)


def _message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def default_system_text(template, where: str = "system_format") -> str | None:
    """Rendered default system block, or None when the template's default is falsy."""
    tpl = _tpl(template)
    if not tpl.system:
        return None
    if tpl.system_format is None:
        raise TemplateError(f"template {tpl.template_name!r} has a default system text but no system format")
    return format_literal(tpl.system_format, tpl.system, where=f"{tpl.template_name}.{where}")


def render_messages(
    df: DataFrame,
    template="qwen",
    eos: str = EOS_TOKEN,
    conv_col: str = "conversations",
    out: str = "messages",
    inject_system: bool = True,
) -> DataFrame:
    """Render each message with its role's format (op 18) and, when no message
    is a system message, prepend the template's default system text (op 19).

    Output ``out``: ``ARRAY<STRUCT<role, text>>``.  Unknown roles are skipped.
    A system message under a template without a system format raises.
    """
    return df.withColumn(out, rendered_messages(template, eos, conv_col, inject_system))


def rendered_messages(template="qwen", eos: str = EOS_TOKEN, conv_col: str = "conversations",
                      inject_system: bool = True) -> Column:
    """The column expression behind ``render_messages``."""
    tpl = _tpl(template)
    name = tpl.template_name
    user = lambda c: format_column(tpl.user_format, c, eos, f"{name}.user_format")
    assistant = lambda c: format_column(tpl.assistant_format, c, eos, f"{name}.assistant_format")
    if tpl.system_format is None:
        system = lambda c: F.raise_error(F.lit(f"template {name!r} has no system format but a system message was given"))  # noqa: E731,E501
    else:
        system = lambda c: format_column(tpl.system_format, c, None, f"{name}.system_format")

    def one(m):
        role, content = m["role"], m["content"]
        rendered = (
            F.when(role == "system", system(content).cast("string"))
            .when(role == "user", user(content))
            .when(role == "assistant", assistant(content))
        )
        return F.struct(role.alias("role"), rendered.alias("text"))

    msgs = F.filter(F.transform(col(conv_col), one), lambda m: m["role"].isin("system", "user", "assistant"))
    if inject_system:
        block = default_system_text(tpl)
        if block is not None:
            has_system = F.exists(col(conv_col), lambda m: m["role"] == "system")
            msgs = F.when(has_system, msgs).otherwise(F.concat(F.array(_message("system", F.lit(block))), msgs))
    return msgs


def render_with_templates(df: DataFrame, names: list[str], eos: str = EOS_TOKEN, conv_col: str = "conversations",
                          out: str = "messages") -> DataFrame:
    """One row per (row, template) rendered in a single pass: the input is
    read once, rows are multiplied by the (small, fixed) template list with a
    generator, and a CASE on the template name picks the rendering."""
    expanded = df.withColumn("template_name", F.explode(F.array(*[F.lit(n) for n in names])))
    case = None
    for n in names:
        branch = rendered_messages(n, eos, conv_col)
        case = F.when(F.col("template_name") == n, branch) if case is None else case.when(F.col("template_name") == n, branch)
    return expanded.withColumn(out, case)


def messages_text(messages) -> Column:
    return F.array_join(F.transform(col(messages), lambda m: m["text"]), "")


def render_preference(
    df: DataFrame,
    template="qwen",
    question: str = "question",
    chosen: str = "response_chosen",
    rejected: str = "response_rejected",
) -> DataFrame:
    """prompt = default system block (if truthy) + user_format(question); responses raw (op 20)."""
    tpl = _tpl(template)
    block = default_system_text(tpl) or ""
    prompt = F.concat(F.lit(block), format_column(tpl.user_format, col(question), None, f"{tpl.template_name}.user_format"))
    return df.withColumn("prompt", prompt).withColumn("chosen", col(chosen)).withColumn("rejected", col(rejected))


def render_reward(
    df: DataFrame,
    template="qwen",
    eos: str = EOS_TOKEN,
    question: str = "question",
    chosen: str = "response_chosen",
    rejected: str = "response_rejected",
) -> DataFrame:
    """Preference prompt + assistant_format(response) for each side (op 21)."""
    tpl = _tpl(template)
    staged = render_preference(df, tpl, question, chosen, rejected)
    where = f"{tpl.template_name}.assistant_format"
    return staged.withColumn(
        "chosen_text", F.concat(F.col("prompt"), format_column(tpl.assistant_format, col(chosen), eos, where))
    ).withColumn("rejected_text", F.concat(F.col("prompt"), format_column(tpl.assistant_format, col(rejected), eos, where)))


def render_scoring_prompt(df: DataFrame, template="qwen", eos: str = EOS_TOKEN, question: str = "question",
                          answer: str = "answer", out: str = "scoring_text") -> DataFrame:
    """question + answer → one scoring prompt (op 22).  A template without a
    default system text gets an empty prefix (the reference would fail)."""
    tpl = _tpl(template)
    block = default_system_text(tpl) or ""
    user = format_column(tpl.user_format, col(question), None, f"{tpl.template_name}.user_format")
    asst = format_column(tpl.assistant_format, col(answer), eos, f"{tpl.template_name}.assistant_format")
    return df.withColumn(out, F.concat(F.lit(block), user, asst))


def render_chat(df: DataFrame, conv_col: str = "conversations", add_generation_prompt: bool = False,
                out: str = "chat_text") -> DataFrame:
    """Generic chat rendering (op 23): default system block when the *first*
    message is not a system message; every role emitted verbatim."""
    conv = col(conv_col)
    body = F.array_join(
        F.transform(conv, lambda m: F.concat(F.lit(IM_START), m["role"], F.lit("\n"), m["content"], F.lit(IM_END + "\n"))),
        "",
    )
    first_not_system = (F.size(conv) > 0) & ~F.coalesce(conv[0]["role"] == "system", F.lit(False))
    text = F.concat(F.when(first_not_system, F.lit(CHAT_DEFAULT_SYSTEM_BLOCK)).otherwise(F.lit("")), body)
    if add_generation_prompt:
        text = F.concat(text, F.lit(CHAT_GENERATION_PROMPT))
    return df.withColumn(out, text)
