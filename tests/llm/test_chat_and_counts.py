import hashlib
import random

import numpy as np
import pytest
from tokenizers import AddedToken, Tokenizer

from graphspark.llm import chat_format, token_counts
from graphspark.llm.tokens import default_path

SAID = "</s>[INST] ok [/INST]"


def test_escapes_are_undone_and_hide_control_strings():
    t, rnd = chat_format.Template(), random.Random(1)
    bits = ["[", "<", "/", "\\", "INST]", "/INST]", "/s>", "[INST]", "</s>", "a", "é", " ", "[\\INST]"]
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(9)))
        hidden = t.escape(text)
        assert t.unescape(hidden) == text and not any(c in hidden for c in t.control)
        assert t.parse(t.render(text, hidden)[0] + t.render("r", text)[0]) == [(text, hidden), ("r", text)]
    with pytest.raises(ValueError):
        chat_format.Template("ab", "bc", "cd")


def conversations():
    rnd = random.Random(2)
    rows = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (None, 0, "user", "x"), (None, None, "assistant", "first"), (5, 0, None, None), (5, 1, "assistant", ""), (5, 1, "assistant", "日本語 é 😀"), (5, 1, "assistant", "日本語 é 😀")]
    for c in range(20):
        rows += [(100 + c, k, ("user", "assistant", "system")[(k + c) % 3], " ".join(rnd.choice(["the", "…", "\n", "I'm", "??", SAID]) for _ in range(rnd.randrange(12)))) for k in range(rnd.randrange(1, 9))]
    return rows


@pytest.mark.parametrize("most", [40, 1_000_000])
def test_read_back_equals_the_turns(spark, most):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, last int").repartition(3)
    made = chat_format.format_conversations(frame, segment_chars=most)
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(frame.limit(0))).count() == 0
    whole = made.where("conv_id = 100").collect()
    lib = Tokenizer.from_file(default_path())
    lib.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in chat_format.Template().control])
    assert sum((list(r.ids) for r in sorted(whole, key=lambda r: r.segment)), []) == lib.encode("".join(r.text for r in sorted(whole, key=lambda r: r.segment)), add_special_tokens=False).ids


def test_line_counts_add_up(spark):
    lib = Tokenizer.from_file(default_path())
    texts = ["a b\n\n\nc d\n", "", None, "\n", "x" * 500, "\n".join(f"line {i} é" for i in range(50)), "a \n \n b"]
    docs = spark.createDataFrame([(i % 6, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    for rule in token_counts.RULES:
        got = token_counts.count_lines(docs, rule=rule).collect()
        want = sum(len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts)
        assert abs(sum(r.n_tokens for r in got) - want) < 1e-9
    assert sum(r.length for r in got) == sum(len(t or "") for t in texts)
    assert token_counts.count_lines(docs.limit(0)).count() == 0


def test_boundary_rules():
    starts, ends, parts = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3])
    want = {"first": [2, 1], "last": [1, 2], "most": [1, 2], "share": [1 + 1 / 3, 1 + 2 / 3]}
    for rule, counts in want.items():
        got, touched = token_counts.allocate(starts, ends, parts, 6, rule)
        assert np.allclose(got, counts) and touched.tolist() == [1, 1]


def test_fields(spark):
    docs = spark.createDataFrame([(1, "web", "the text", None)], "doc_id long, source string, text string, x string")
    got = {r.part: r.n_tokens for r in token_counts.count_fields(docs, "doc_id", ["source", "text", "x"]).collect()}
    assert got[0] >= 1 and got[1] >= 2 and sum(got.values()) == len(Tokenizer.from_file(default_path()).encode("web\nthe text\n", add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        token_counts.count_lines(docs, rule="none")
