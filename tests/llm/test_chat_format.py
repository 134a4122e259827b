"""Chat formatting against whole renderings and plain digests."""

import hashlib
import random

import pytest

from hydroframe.llm import chat_format as chat
from hydroframe.llm import workload

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    """Conversations of (id, turn, role, text): id to turns."""
    out = {}
    for conv, turn, role, text in sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    ):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = []
    for conv, turns in in_order(rows).items():
        said = "".join(text for role, text in turns if role == "assistant")
        out.append((
            conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said),
            len(chat.marked_turns(turns)), False,
        ))
    return sorted(out, key=repr)


def read(made):
    names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars rewritten".split()
    return sorted((tuple(r[n] for n in names) for r in made.collect()), key=repr)


def test_query_equals_plain_digests(spark):
    rows = [tuple(r) for r in workload.load(spark, SF_DIR, "conversations").collect()]
    rows += [(-7, n, role, "\\### Assistant: </turn> ok") for n, role in enumerate(("user", "assistant"))]
    assert read(workload.QUERIES["op11_chat_format"](spark, SF_DIR)) == plain(rows)


NASTY = ["\\", "###", "</turn>", "<", "\n", ":", "### user:\n", "\\\\</turn>\n", "a", "\U0001f600", "é", "\r\n", "\x00", ""]


def test_escapes_are_reversible():
    draw = random.Random(1)
    for _ in range(3000):
        turns = [("".join(draw.choices(NASTY, k=draw.randrange(5))), "".join(draw.choices(NASTY, k=6))) for _ in range(3)]
        assert list(chat.read_turns(chat.marked_turns(turns))) == turns


def test_no_output_of_the_template():
    with pytest.raises(ValueError):
        list(chat.read_turns("### user:\nopen"))


def pushed(template, turns, **how):
    so_far = chat.Incremental(template, **how)
    return [so_far.push(turn) for turn in turns]


def patched(pieces):
    out = ""
    for made in pieces:
        out = out[: made["start"]] + made["piece"]
    return out


def begins(turns):
    return "<s>" + "".join(f"[{r}] {t} [/{r}]" for r, t in turns)


def trims(turns):
    return "".join(f"{r}: {t.strip()}\n" for r, t in turns)


def closes(turns):
    return "".join(f"{r}: {t}\n" for r, t in turns) + "</s>"


def drops_thoughts(turns):
    """Only the last turn keeps what stands in brackets."""
    last = len(turns) - 1
    return "".join(f"{r}: {t if i == last else t.split('(')[0]}\n" for i, (r, t) in enumerate(turns))


def counts(turns):
    return "".join(f"{i}. {t}\n" for i, (_, t) in enumerate(turns))


TURNS = [("system", "be good"), ("user", " hi "), ("assistant", "(hm) hello"), ("user", ""), ("assistant", "bye")]


@pytest.mark.parametrize("template", [chat.marked_turns, begins, trims, closes, drops_thoughts, counts])
def test_pieces_make_the_output_of_any_template(template):
    assert patched(pushed(template, TURNS)) == template(TURNS)


def test_rewriting_is_told():
    told = {t.__name__: [m["rewritten"] for m in pushed(t, TURNS)] for t in (begins, trims, closes, drops_thoughts)}
    assert told["begins"] == told["trims"] == [False] * 5
    assert told["closes"] == [True] * 5
    assert told["drops_thoughts"] == [False, False, False, True, False]


@pytest.mark.parametrize("template", [chat.marked_turns, begins, trims])
def test_places_of_texts(template):
    out = template(TURNS)
    got = [out[m["text_start"] : m["text_end"]] for m in pushed(template, TURNS)]
    assert got == [text.strip() if template is trims else text for _, text in TURNS]


def test_texts_that_look_like_what_surrounds_them():
    turns = [("assistant", x) for x in ("</turn>", "\n", "### assistant:\n", "b", "aa", "</turn>\n</turn>")]
    out = chat.marked_turns(turns)
    got = [chat.unescaped(out[m["text_start"] : m["text_end"]]) for m in pushed(chat.marked_turns, turns)]
    assert got == [text for _, text in turns]


@pytest.mark.parametrize("template", [chat.marked_turns, begins, trims])
def test_windows_change_nothing(template):
    turns = [(("user", "assistant")[i % 2], f"text {i} " * (i % 5)) for i in range(300)]
    assert pushed(template, turns, window=7) == pushed(template, turns, window=1000)
    assert patched(pushed(template, turns)) == template(turns)


def test_a_template_of_longer_memory_is_told():
    turns = [("user", str(i)) for i in range(20)]
    told = [m["rewritten"] for m in pushed(counts, turns, window=8, context=2)]
    assert told[:8] == [False] * 8 and told[8]


def recalls(turns):
    """A turn that asks for it repeats the first one."""
    return "".join(f"{r}: {t}{turns[0][1] if 'again' in t else ''}\n" for r, t in turns)


def seldom_again(n):
    return [(("user", "assistant")[i % 2], f"{i} (hm) " + "again" * (i in (100, n - 9))) for i in range(n)]


@pytest.mark.parametrize("template", [chat.marked_turns, begins, trims, closes, drops_thoughts, counts, recalls])
@pytest.mark.parametrize("n", [7, 8, 20, 64, 65, 66, 300])
def test_pieces_of_long_conversations_make_the_output_of_any_template(template, n):
    for window in (7, chat.WINDOW, None):
        made = list(chat.rendered(template, iter(seldom_again(n)), window))
        assert patched(made) == chat.patched(made) == template(seldom_again(n))
        assert made == list(chat.rendered(template, seldom_again(n), None))


def test_a_template_of_any_memory_in_the_operator(spark):
    def recalling(turns):
        return "".join(f"{i} {r}: {t}{turns[0][1] if 'again' in t else ''}\n" for i, (r, t) in enumerate(turns))

    turns = seldom_again(150)
    data = spark.createDataFrame([(c, i, *turn) for c in (1, 2) for i, turn in enumerate(turns)], SCHEMA)
    made = chat.format_conversations(data, recalling).collect()
    for c in (1, 2):
        own = sorted((r for r in made if r.conv_id == c), key=lambda r: r.place)
        assert patched(own) == recalling(turns)
        whole = list(chat.rendered(recalling, turns, None))
        assert [{name: r[name] for name in whole[0]} for r in own] == whole


def test_turns_of_a_template_without_memory_are_not_held():
    taken = []

    def turns():
        for i in range(1000):
            taken.append(i)
            yield "user", f"text {i}"

    assert [len(taken) for _ in chat.rendered(chat.marked_turns, turns())] == list(range(1, 1001))


def test_a_false_memory_is_an_error():
    def template(turns):
        return counts(turns)

    template.memory = 3
    with pytest.raises(ValueError, match="more than 3 turns"):
        list(chat.rendered(template, seldom_again(100)))


def test_a_memory_longer_than_the_context_is_kept():
    def template(turns):
        return "".join(f"{t} after {[x for _, x in turns[max(0, i - 5) : i]]}\n" for i, (_, t) in enumerate(turns))

    template.memory = 5
    assert patched(chat.rendered(template, seldom_again(300))) == template(seldom_again(300))


def test_proving_takes_time_in_proportion():
    asked = 0

    def template(turns):
        nonlocal asked
        asked += len(turns)
        return begins(turns)

    assert chat.patched(chat.rendered(template, [("user", "x")] * 20_000)) == begins([("user", "x")] * 20_000)
    assert asked < 20_000 * 4 * chat.WINDOW


def test_a_long_conversation_takes_time_in_proportion():
    rendered = 0

    def template(turns):
        nonlocal rendered
        rendered += len(turns)
        return chat.marked_turns(turns)

    pushed(template, [("user", "x")] * 20_000)
    assert rendered < 20_000 * 4 * chat.WINDOW


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "assistant", None), (None, None, "assistant", "x"), (1, 2, "assistant", "é"),
        (1, 2, "assistant", "é"), (1, None, "user", "</turn>"), (1, -5, "ass:istant\n###", "\\"), (2, 0, "assistant", ""),
        (2, 0, "assistant", "b"), (2, 0, "Assistant", "c"), (3, 1, "assistant", "long " * 200_000),
    ]
    rows += [(4, n, "assistant" if n % 2 else "user", f"</turn>{n}") for n in range(200)]
    data = spark.createDataFrame(rows, SCHEMA)
    assert read(chat.read_back(chat.format_conversations(data))) == plain(rows)


def test_pieces_and_spans(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "</turn>!")]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    out = "".join(r.piece for r in made)
    assert out == "### user:\nhi</turn>\n### assistant:\n\\</turn>!</turn>\n"
    assert [(r.loss, out[r.text_start : r.text_end]) for r in made] == [(False, "hi"), (True, "\\</turn>!")]


def test_other_columns_and_empty_table(spark):
    schema = "c string, n int, who string, said string, place int, piece string, conv_id int, text string, loss int"
    data = spark.createDataFrame([("x", 1, "assistant", "Hi", 1, "p", 2, "t", 0)], schema)
    names = dict(conversation="c", turn="n", role="who", text="said")
    made = chat.format_conversations(data, trained=["assistant"], **names)
    assert [(r.conv_id, r.piece, r.loss) for r in made.collect()] == [("x", "### assistant:\nHi</turn>\n", True)]
    assert chat.read_back(chat.format_conversations(data.limit(0), **names)).collect() == []
