"""Template rendering (ops 17-23) against a sequential str.format spec."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.fixed import EOS_TOKEN, TEMPLATE_ROWS
from tessera.functions.templates import TemplateError, get_template, register_template, template_names, templates
from tessera.operators.render import (
    messages_text,
    render_chat,
    render_messages,
    render_preference,
    render_reward,
    render_scoring_prompt,
)

SCHEMA = "pos bigint, conversations array<struct<role:string,content:string>>"


def spec_render(conv, name, eos=EOS_TOKEN):
    """Per message format by role, unknown roles skipped, default system
    prepended when no message is a system message and the default is truthy."""
    t = get_template(name)
    out, has_system = [], False
    for m in conv:
        if m["role"] == "system":
            has_system = True
            out.append(t.system_format.format(content=m["content"]))
        elif m["role"] == "user":
            out.append(t.user_format.format(content=m["content"], stop_token=eos))
        elif m["role"] == "assistant":
            out.append(t.assistant_format.format(content=m["content"], stop_token=eos))
    if not has_system and t.system:
        out.insert(0, t.system_format.format(content=t.system))
    return "".join(out)


def msg(role, content):
    return {"role": role, "content": content}


CONVS = [
    [msg("user", "hi"), msg("assistant", "yo")],
    [msg("user", "a"), msg("assistant", "b"), msg("system", "late system"), msg("user", "c")],
    [msg("system", "s1"), msg("system", "s2"), msg("user", "u")],
    [msg("tool", "ignored"), msg("user", "q"), msg("assistant", "r")],
    [],
    [msg("user", "{content} {stop_token} $1 %s {} \\1"), msg("assistant", "{{x}} $0")],
]


def render_all(spark, name):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CONVS)], SCHEMA)
    out = render_messages(df, name).select("pos", messages_text("messages").alias("t")).orderBy("pos").collect()
    return [r.t for r in out]


@pytest.mark.parametrize("name", [n for n in template_names() if get_template(n).system_format is not None])
def test_render_matches_spec(spark, name):
    assert render_all(spark, name) == [spec_render(c, name) for c in CONVS]


def test_template_without_system_format_raises_on_system_message(spark):
    df = spark.createDataFrame([(0, [msg("system", "s"), msg("user", "u")])], SCHEMA)
    with pytest.raises(Exception, match="no system format"):
        render_messages(df, "deepseek").select(messages_text("messages")).collect()
    ok = spark.createDataFrame([(0, [msg("user", "u")])], SCHEMA)
    assert render_messages(ok, "deepseek").select(messages_text("messages").alias("t")).first().t == \
        "User: u\n\nAssistant: "


def test_chatglm2_needs_idx():
    with pytest.raises(TemplateError, match="idx"):
        from tessera.functions.templates import split_format

        split_format(get_template("chatglm2").user_format, EOS_TOKEN)


def test_mistral_with_and_without_system(spark):
    df = spark.createDataFrame([(0, [msg("system", "ignored"), msg("user", "u")]), (1, [msg("user", "u")])], SCHEMA)
    got = [r.t for r in render_messages(df, "mistral").select("pos", messages_text("messages").alias("t"))
           .orderBy("pos").collect()]
    assert got == ["<s>[INST]u[/INST]", "[INST]u[/INST]"]


def test_unknown_template_and_registry(spark):
    with pytest.raises(TemplateError, match="known templates"):
        get_template("nope")
    assert templates(spark).count() == len(TEMPLATE_ROWS) == 22
    register_template("tmp_x", "S{content}", "U{content}", "A{content}{stop_token}", "sys")
    register_template("tmp_x", "S2{content}", "U{content}", "A{content}{stop_token}", "sys")
    assert get_template("tmp_x").system_format == "S2{content}"


def test_preference_reward_and_scoring(spark):
    df = spark.createDataFrame([("q$1", "c", "r")], "question string, response_chosen string, response_rejected string")
    t = get_template("qwen")
    prompt = t.system_format.format(content=t.system) + t.user_format.format(content="q$1")
    p = render_preference(df, "qwen").first()
    assert (p.prompt, p.chosen, p.rejected) == (prompt, "c", "r")
    r = render_reward(df, "qwen").first()
    assert r.chosen_text == prompt + t.assistant_format.format(content="c", stop_token=EOS_TOKEN)
    assert r.rejected_text == prompt + t.assistant_format.format(content="r", stop_token=EOS_TOKEN)
    s = render_scoring_prompt(df.withColumnRenamed("response_chosen", "answer"), "yi").first()
    y = get_template("yi")
    assert s.scoring_text == y.user_format.format(content="q$1") + y.assistant_format.format(
        content="c", stop_token=EOS_TOKEN)


def test_render_chat(spark):
    df = spark.createDataFrame(
        [(0, [msg("user", "u")]), (1, [msg("system", "S"), msg("tool", "t")]), (2, [])], SCHEMA)
    got = [r.chat_text for r in render_chat(df, add_generation_prompt=True).orderBy("pos").collect()]
    block = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
    assert got[0] == block + "<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"
    assert got[1] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>tool\nt<|im_end|>\n<|im_start|>assistant\n"
    assert got[2] == "<|im_start|>assistant\n"


def test_flat_turns_roundtrip(spark):
    from tessera.sources.tables import flat_turns_to_conversations

    turns = spark.createDataFrame([(5, 1, "assistant", "b"), (5, 0, "user", "a"), (6, 0, "user", "z")],
                                  "conv_id bigint, turn bigint, role string, text string")
    out = {r.pos: [(m.role, m.content) for m in r.conversations]
           for r in flat_turns_to_conversations(turns).collect()}
    assert out == {5: [("user", "a"), ("assistant", "b")], 6: [("user", "z")]}
    assert F is not None
