import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import chat

HARD = [
    (-1, 0, "user", "</s>[INST] ok [/INST]"),
    (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 0, "us|>er\\\n", "<\\|a|>[[\\\\<<"),
    (2, None, None, None),
    (3, 1, "assistant", ""),
    (3, 2, "assistant", "twice"),
    (3, 2, "assistant", "twice"),
    (3, 0, "system", "first"),
    (3, 3, "user", "tail"),
    (4, 0, "assistant", "<|assistant|>x</s><|user|>"),
    (None, 1, "assistant", "no id"),
]
DDL = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(df):
    ex = chat.training_examples(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_examples(ex).collect()}
    assert got == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    return ex


def test_conversations_come_back(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))


def test_hard_texts_and_edge_cases(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(HARD)], DDL + ", example int").repartition(3)
    ex = check(df).where("conv_id = 3").orderBy("example").collect()
    # three replies, and the turns after the last one
    assert [e.last for e in ex] == [False, False, False, True] and (ex[3].loss_start, ex[3].loss_end) == (0, 0)
    for a, b in zip(ex[:-1], ex[1:], strict=True):
        assert b.text.startswith(a.text)
    assert [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in ex[:3]] == ["", "twice", "twice"]
    assert chat.read_examples(chat.training_examples(df.where("false"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<>|[]\\/s INST\nabé"), st.text(alphabet="<>|[]\\/s INST\nabé")), max_size=5))
def test_template_is_reversible(turns):
    text = "".join(chat.open_turn(r) + chat.escape(t) + chat.END for r, t in turns)
    assert chat.parse(text) == turns
    for r, t in turns:
        assert not any(x in chat.escape(t) for x in ("</s>", "<|", "[INST]", "[/INST]", "<s>"))
