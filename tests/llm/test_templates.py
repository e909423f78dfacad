"""The template language: forms that published chat templates use, what it refuses, and conversations that stream."""

import pytest

from sparquill.llm import chat, templates

TALK = [{"role": r, "content": c} for r, c in (("system", "Be brief."), ("user", " Hi {{ x }} "), ("assistant", "Hello."), ("user", "Bye"))]
CHATML = (
    "{% for message in messages %}{% if loop.first and messages[0]['role'] != 'system' %}{{ '<|im_start|>system\\nDefault<|im_end|>\\n' }}{% endif %}"
    "{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)
BRACKETS = """{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% set system_message = false %}{% endif %}
{%- for message in loop_messages -%}
  {%- if (message['role'] == 'user') != (loop.index0 % 2 == 0) -%}{{ raise_exception('roles must take turns') }}{%- endif -%}
  {%- if loop.index0 == 0 and system_message != false -%}{%- set content = '<<SYS>>\\n' + system_message + '\\n<</SYS>>\\n\\n' + message['content'] -%}
  {%- else -%}{%- set content = message['content'] -%}{%- endif -%}
  {%- if message['role'] == 'user' -%}{{ bos_token + '[INST] ' + content.strip() + ' [/INST]' }}
  {%- elif message['role'] == 'assistant' -%}{% generation %}{{ ' ' + content.strip() + ' ' + eos_token }}{% endgeneration %}{%- endif -%}
{%- endfor -%}"""
LINES = """{# one marker a line #}
{% for m in messages %}
  {% if m.role == 'user' %}
{{ '<|user|>\\n' + m.content | trim + eos_token }}
  {% elif m.role == 'assistant' %}
{{ '<|assistant|>\\n' + m.content + eos_token }}
  {% endif %}
  {% if loop.last and add_generation_prompt %}
{{ '<|assistant|>' }}
  {% endif %}
{% endfor %}
"""


def said(template, turns, variables=None, trim_blocks=False):
    return "".join(t for t, _ in templates.compile_template(template, variables, trim_blocks)(iter(turns)))


def test_published_forms():
    marked = "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in TALK)
    assert said(CHATML, TALK) == marked
    assert said(CHATML, TALK[1:2], {"add_generation_prompt": True}) == "<|im_start|>system\nDefault<|im_end|>\n<|im_start|>user\n Hi {{ x }} <|im_end|>\n<|im_start|>assistant\n"
    names = {"bos_token": "<s>", "eos_token": "</s>"}
    assert said(BRACKETS, TALK, names) == "<s>[INST] <<SYS>>\nBe brief.\n<</SYS>>\n\n Hi {{ x }} [/INST] Hello. </s><s>[INST] Bye [/INST]"
    assert [t for t, learn in templates.compile_template(BRACKETS, names)(iter(TALK)) if learn] == [" Hello. </s>"]
    with pytest.raises(templates.TemplateError, match="take turns"):
        said(BRACKETS, TALK[2:], names)
    assert said(LINES, TALK, {**names, "add_generation_prompt": True}, True) == "<|user|>\nHi {{ x }}</s>\n<|assistant|>\nHello.</s>\n<|user|>\nBye</s>\n<|assistant|>\n"
    assert said("", TALK) == said(CHATML, []) == ""


def test_expressions():
    given = {"n": 7, "s": "ab", "none_": None, "l": ["p", "q"]}
    for source, result in {
        "n % 4 + 1 - 2": "2",
        "n // 2 ~ s": "3ab",
        "-n": "-7",
        "s[0] + s[1:] + s[-1]": "abb",
        "l[1] ~ l | length": "q2",
        "'it\\'s' + \"\\n\\\\\"": "it's\n\\",
        "s is defined and t is not defined": "True",
        "none_ is none": "True",
        "t | default('d')": "d",
        "t": "",
        "'a' in s and 'x' not in s": "True",
        "'y' if n > 6 else 'z'": "y",
        "'y' if n <= 6": "",
        "s.upper().replace('A', '}}')": "}}B",
        "l | tojson": '["p", "q"]',
        "'AB' | lower | capitalize": "Ab",
        "not (n == 7 or s)": "False",
    }.items():
        assert said("{{ " + source + " }}", [], given) == result, source
        kept = templates.compile_template("{% set n = n %}{% set s = s %}{% set l = l %}{% set none_ = none_ %}{{ " + source + " }}", given)  # nothing to fold
        assert "".join(t for t, _ in kept(iter(()))) == result, source
    assert templates.fold_body(templates.parse("a{% if n == 7 %}{{ s + 'c' }}{% elif x %}d{% endif %}{# e #}"), given) == [("text", "aabc")]


def test_names_and_loops():
    assert said("{% set k = 'a' %}{% for x in l %}{% set k = k + x %}{{ k }} {% endfor %}{{ k }}", [], {"l": ["1", "2"]}) == "a1 a2 a"
    assert said("{% set ns = namespace(k='a') %}{% for x in l %}{% set ns.k = ns.k + x %}{% endfor %}{{ ns.k }}", [], {"l": ["1", "2"]}) == "a12"
    assert said("{% for x in l %}{{ loop.index }}{{ x }}{{ loop.previtem }}{{ loop.nextitem }}{% if not loop.last %},{% endif %}{% endfor %}", [], {"l": ["p", "q"]}) == "1pq,2qp"
    assert said(" a {%- if true -%} b {%- endif %} c {{- 'd' -}} e", []) == " ab cde"


@pytest.mark.parametrize(
    "bad",
    [
        "{{ x.__class__ }}", "{{ ''.format(x) }}", "{{ x.pop() }}", "{{ open('f') }}", "{% include 'f' %}", "{{ 1 + 'a' }}", "{{ '%s' % 'a' }}", "{{ 1 // 0 }}", "{% if %}{% endif %}",
        "{{ 'a' * 9 }}", "{% for m in messages %}", "{% endfor %}", "{{ x", "{{ loop }", "{% set turns = 1 %}", "{{ messages | length }}", "{{ messages[-1] }}", "{{ messages[:1] }}",
        "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for m in messages %}{{ loop.length }}{% endfor %}", "{{ x is odd }}", "{{ if }}", "{{ lipsum.x.y }}",
    ],
)
def test_refused(bad):
    with pytest.raises(templates.TemplateError):
        said(bad, TALK, {"x": "a"} if "lipsum" not in bad else {})


def test_turns_stream():
    """Of a conversation of any length only the first turns and those beside the one at hand are held."""
    turns = templates.Turns({"text": str(k)} for k in range(100_000))
    seen, most = 0, 0
    for turn, loop in templates.View(turns).loops():
        assert turn["text"] == str(loop.get("index0")) and loop.get("last") == (seen == 99_999)
        seen, most = seen + 1, max(most, len(turns.held))
    assert (seen, most, len(turns.head)) == (100_000, 3, turns.HEAD)
    with pytest.raises(templates.TemplateError):
        turns.at(10)


def test_published_form_over_a_table(spark):
    rows = [(c, k, m["role"], m["content"], "x") for c in (1, 2, None) for k, m in enumerate(TALK)] + [(3, 0, None, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(turns, CHATML).collect()}
    assert got == {c: said(CHATML, TALK) for c in (1, 2, None)} | {3: said(CHATML, [{"role": "", "content": ""}])}
    with pytest.raises(templates.TemplateError):
        chat.format_conversations(turns, "{{ x | eval }}")
