import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from listwright.llm import chat_format as chat

TEXT = st.text(alphabet=st.sampled_from("\\#<>/turn: \nhtcé"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_the_template_can_be_read_back(turns):
    made = "".join(chat.BEGIN + chat.escape(r, True) + chat.MIDDLE + chat.escape(t) + chat.CLOSE for r, t in turns)
    assert chat.parse(made) == turns
    for _, text in turns:
        assert "###" not in chat.escape(text) and "</turn>" not in chat.escape(text)


def rows_of(conversations):
    return [(c, k, role, text, "x") for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]


SCHEMA = "conv_id bigint, turn int, role string, text string, node string"


def some_conversations():
    random.seed(3)
    first = ("user", "shared first turn")
    out = {i: [first, ("assistant", f"answer {i % 5}"), ("user", f"more {i % 7}"), ("assistant", "bye")][: 1 + i % 4] for i in range(60)}
    out[100] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    out[101] = [("system", ""), ("user", None), (None, "x"), ("assistant", None)]
    out[102] = [("user" if i % 2 else "assistant", f"turn {i} é😀") for i in range(300)]
    out[103] = [("assistant", "y" * 200_000)]
    out[None] = [("user", "no id"), ("assistant", "none")]
    return out


def test_conversations_are_read_back(spark):
    given_ = some_conversations()
    rows = rows_of(given_)
    random.shuffle(rows)
    got = {r.conv_id: r for r in chat.read_back(*chat.format_tree(spark.createDataFrame(rows, SCHEMA))).collect() if r.conv_id is not None}
    for c, turns in given_.items():
        if c is None:
            continue
        learned = "".join(t or "" for r, t in turns if r == "assistant")
        said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (said, learned))


def test_the_tree_is_depth_first_and_shared(spark):
    given_ = some_conversations()
    segments, leaves = chat.format_tree(spark.createDataFrame(rows_of(given_), SCHEMA))
    nodes = {bytes(r.node): r for r in segments.collect()}
    prefixes = {tuple((r or "", t or "") for r, t in turns[: k + 1]) for turns in given_.values() for k in range(len(turns))}
    assert len(nodes) == len(prefixes)  # every shared turn once
    at, stack = 0, []
    for r in sorted(nodes.values(), key=lambda r: r.start):
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens
        while stack and bytes(stack[-1].node) != (bytes(r.parent) if r.parent else None):
            stack.pop()
        assert bool(stack) == (r.parent is not None) and len(stack) == r.depth
        assert r.position == sum(s.n_tokens for s in stack)
        covered = [x for i in r.attends for x in range(i.begin, i.end)]
        assert covered == [x for s in stack for x in range(s.start, s.start + s.n_tokens)]
        assert all(a.end < b.begin for a, b in zip(r.attends, r.attends[1:]))
        stack.append(r)
    assert leaves.count() == len(given_)


def test_repeated_turns_and_empty_tables(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, None, "system", "s", "x"), (1, 0, "user", "a", "x")]
    r = chat.read_back(*chat.format_tree(spark.createDataFrame(rows, SCHEMA))).first()
    assert r.turns_sha256 == hashlib.sha256(b"system\ns\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert chat.read_back(*chat.format_tree(spark.createDataFrame([], SCHEMA))).count() == 0
