import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treewright.llm import chat

PIECES = st.lists(st.sampled_from(["<|start|>", "<|end|>\n", "<", "[", "\\", "|", "</s>", "s>", "[INST]", "/INST]", "<<SYS>>", "SYS>", "\n", "é", "a", "[/INST]", "<\\|end|>"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escapes_are_reversible_and_complete(text):
    data = text.encode()
    out = chat.escape(data)
    assert chat.unescape(out) == data
    assert all(c not in out for c in (b"<|", b"</s>", b"<s>", b"[INST]", b"[/INST]", b"<SYS>"))
    role = chat.escape_role(data)
    assert b"\n" not in role and chat.unescape_role(role) == data


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=6))
def test_assembly_is_the_template(turns):
    roles, texts = [chat.escape_role(r.encode()) for r, _ in turns], [chat.escape(t.encode()) for _, t in turns]
    buffer, starts, bodies = chat.assemble(roles, texts)
    plain = [b"<|start|>" + r + b"\n" + t + b"<|end|>\n" for r, t in zip(roles, texts)]
    assert buffer.tobytes() == b"".join(plain)
    assert starts.tolist() == [sum(map(len, plain[:k])) for k in range(len(plain) + 1)]
    assert [buffer[a : a + len(t)].tobytes() for a, t in zip(bodies.tolist(), texts)] == texts
    assert chat.read_turns(buffer.tobytes()) == [(r.encode(), t.encode()) for r, t in turns]


def rows():
    r = random.Random(3)
    out = []
    for c in [*range(30), None]:
        for t in range(r.randrange(1, 9)):
            out.append((c, t, r.choice(["user", "assistant", "system", None, "as\nsistant", "assistant"]), r.choice(["", None, "hé 👍", "</s>[INST] x", "a\\n<|end|>\n", "z" * 40])))
    return out + [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (4, None, "assistant", "first"), (50, 1, "assistant", "long " * 400000)]


def plain(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    done = []
    for c, turns in out.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        done.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(done, key=str)


@pytest.mark.parametrize(("segment", "at_once"), [(4 << 20, 8 << 20), (100, 60)])
def test_round_trip(spark, segment, at_once):
    turns = spark.createDataFrame([(*x, b"q") for x in rows()], "conv_id long, turn long, role string, text string, formatted binary")
    got = chat.digests(chat.format_chats(turns, segment=segment, at_once=at_once)).collect()
    assert sorted((tuple(x[:5]) for x in got), key=str) == plain(rows())


def test_query_and_empty(spark, tmp_path):
    from treewright.llm.queries import op9_chat

    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (x,) = op9_chat(spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert tuple(x[:5]) == (-1, 2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
