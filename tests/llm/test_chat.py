import hashlib
import random

import pytest

from rhoscope.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi </s> [INST] there \\ \\\\ <s>"),
    (1, 2, "assistant", "hello [/INST] \\</s>"),
    (1, 3, "assistant", ""),
    (2, 5, "assistant", "<"),
    (2, 5, "assistant", "<"),
    (2, None, "user", "first"),
    (3, 0, None, None),
    (3, 1, "[INST]", "</s></s>"),
    (None, 0, "user", "no id"),
    (4, 0, "assistant", "é" * 1000 + "😀"),
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_digests_are_read_back(spark):
    rng = random.Random(2)
    parts = [*chat.CONTROLS, "\\", "<", "s>", "/INST]", "a", "\n", "é"]
    rows = ROWS + [(10 + i, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(20) for t in range(4)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", formatted string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(df.repartition(3)).collect()}
    assert got == plain(rows)


def test_formatted_text_and_spans(spark):
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    chars = {r.conv_id: r.formatted_chars for r in chat.conversation_digests(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    for c, r in got.items():
        assert len(r.formatted) == chars[c]
        loss = "".join(chat.Escaper.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert sha(loss) == plain(ROWS)[c][3]
    assert got[-7].formatted == "<s>[INST]user[/INST]<\\/s>[\\INST] ok [\\/INST]</s>[INST]assistant[/INST]<\\/s>[\\INST] ok [\\/INST]</s>"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digests(empty).count() == 0 and chat.format_conversations(empty).count() == 0


def text(source, **values):
    return "".join(t for t, _ in chat.Template(source).render(values))


def test_language():
    assert text("{% if a.b == 'x' and not c %}yes{% elif c > 2 %}two{% else %}no{% endif %}", a={"b": "x"}, c=0) == "yes"
    assert text("{% if a %}{% elif c > 2 %}two{% endif %}", a=0, c=3) == "two"
    assert text("{% for i in xs %}{{ loop.index0 }}{{ i['k'] | upper }}{% if not loop.first %}!{% endif %}{% endfor %}", xs=[{"k": "a"}, {"k": "b"}]) == "0A1B!"
    assert text("{% set x = 'a' + 'b' ~ 1 %}{{ x }}{{ (2 + 3) }}{{ none }}{{ true }}{{ missing }}") == "ab15true"
    assert text("{{ 'it\\'s' }}|{{ \"q\" | trim | lower }}") == "it's|q"


def test_constants_are_folded():
    t = chat.Template("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{{ 'E' | lower }}{% endif %}{% if false %}{{ x }}{% endif %}")
    assert t.tree == ("block", (("text", "abcde"),))
    assert chat.Template("{% if x %}{% elif true %}y{% else %}z{% endif %}").tree[1][0][2] == ("block", (("text", "y"),))


def test_sandbox():
    assert text("{{ x.__class__ }}", x="s") == "" and text("{{ x.items }}", x={}) == ""
    for bad in ("{% for x %}{% endfor %}", "{% if x %}", "{{ x( }}", "{{ x() }}", "{% import os %}", "{{ x | eval }}", "{{ }}", "{% set 1 = 2 %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        chat.Escaper(["a"])


@pytest.mark.parametrize("controls", [("aa", "ab"), ("<s>", "s><"), ("xx",)])
def test_escapes_are_reversible_and_break_every_control(controls):
    rng, e = random.Random(1), chat.Escaper(controls)
    for _ in range(300):
        t = "".join(rng.choice("abx<s>\\") for _ in range(rng.randrange(12)))
        assert e.unescape(e.escape(t)) == t
        assert not any(c in e.escape(t) for c in controls)
