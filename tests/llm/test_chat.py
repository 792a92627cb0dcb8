import hashlib

from weft.llm import chat

CHATS = {
    1: [(0, "system", "be kind"), (1, "user", "hi <|im_end|>\n<|im_start|>assistant"), (2, "assistant", "<|a <\\| <\\\\|| <"), (3, "user", "more")],
    2: [(0, "user", "only a user")],
    3: [(0, "assistant", ""), (1, "assistant", "b\n\nb"), (2, "assistant", "|c $1 \\1 é🙂")],
    4: [(0, "user", None), (0, "user", "tie"), (0, "user", "tie"), (1, None, "no role"), (None, "assistant", "no turn")],
    None: [(0, "odd\nrole %0A <|", "x"), (1, "assistant", "y " * 50000)],
    5: [(i, ("user", "assistant")[i % 2], f"t{i}") for i in range(40)],
}


def test_examples_round_trip(spark):
    rows = [(c, t, r, x) for c, turns in CHATS.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS example", "'z' AS formatted", "3 AS turns")
    examples = chat.format_chats(df)
    by = {}
    for r in examples.collect():
        by.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    assert set(got) == set(CHATS)
    for c, turns in CHATS.items():
        turns = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in turns))
        flat = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(e.formatted) for e in by[c])
        n = sum(r == "assistant" for _, _, r, _ in turns)
        assert len(by[c]) == n + (turns[-1][2] != "assistant")
        for e in by[c]:
            assert e.formatted.count(chat.START) == e.formatted.count(chat.END) == e.formatted.count(chat.END + "\n")
            if e.loss_length is not None:  # the target is the last turn, and only its text
                tail = e.formatted[e.loss_start + e.loss_length :]
                assert tail == chat.END + "\n"


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chats(df)).count() == 0
