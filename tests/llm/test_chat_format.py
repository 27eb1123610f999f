from quire.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_split_quotes():
    own, q = C.split_quotes("> first\n>> nested one\n>> nested two\n> > spaced\nmy words\n  > again\nend")
    assert own == "my words\nend"
    assert q == [(1, "first"), (2, "nested one\nnested two\nspaced"), (1, "again")]
    assert C.split_quotes("On Monday Ann wrote:\n> hi there\nyes") == ("yes", [(1, "hi there")])
    assert C.split_quotes("a > b") == ("a > b", []) and C.split_quotes(None) == ("", [])
    assert C.split_quotes("On Monday Ann wrote: nothing")[1] == []


ROWS = [
    (1, 0, "user", "How do I sort?\nIt has to be fast."),
    (1, 1, "assistant", "Use the library.\n\nIt is fast."),
    (1, 2, "user", "> how do i   sort?\nSame question from me"),
    (1, 3, "assistant", "> Use the library.\n>> How do I sort?\nThanks"),
    (1, 4, "user", ">> Use the library.\n> Thanks\nWelcome"),
    (1, 5, "user", "> said nowhere\nHm"),
    (1, 6, "user", "> Same question from me"),
    (2, 0, "user", "> Use the library.\nother conversation"),
    (2, 1, "user", None),
    (None, 0, "user", "> Use the library."),
    (2, 1, "user", ""),
]


def test_threads(spark):
    got = C.report(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    r = {(x["conv_id"], x["turn"]): x for x in got.filter("conv_id IS NOT NULL").collect()}
    assert got.count() == len(ROWS)
    assert {k: v["reply_to"] for k, v in r.items()} == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): 3, (1, 5): None, (1, 6): 2, (2, 0): None, (2, 1): None}
    assert [r[1, i]["thread"] for i in range(7)] == [0, 1, 0, 1, 1, 5, 0] and [r[1, i]["depth"] for i in range(7)] == [0, 0, 1, 1, 2, 0, 2]
    assert r[1, 4]["text"] == "Welcome" and r[1, 6]["text"] == "" and r[2, 0]["text"] == "other conversation"
    assert C.report(spark.createDataFrame([], SCHEMA)).count() == 0
    chats = {(x["conv_id"], x["thread"]): [m["text"] for m in x["messages"]] for x in C.chats(got.filter("conv_id = 1")).collect()}
    assert chats[1, 0] == ["How do I sort?\nIt has to be fast.", "Same question from me", ""] and chats[1, 1][1:] == ["Thanks", "Welcome"]


def test_long_chain_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 8)
    rows = [(7, 0, "user", "message number 0 here")] + [(7, i, "user", f"> message number {i - 1} here\nmessage number {i} here") for i in range(1, 60)]
    r = {x["turn"]: x for x in C.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r[i]["depth"] == i and r[i]["thread"] == 0 and r[i]["reply_to"] == (i - 1 if i else None) for i in range(60))


def test_the_latest_earlier_message_counts(spark):
    rows = [(1, i, "u", "a common line") for i in range(5)] + [(1, 5, "u", "> a common line\nx"), (1, 6, "u", "a common line")]
    r = {x["turn"]: x["reply_to"] for x in C.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert r[5] == 4 and r[6] is None


def test_quoted_sentences_and_short_messages(spark):
    texts = ["It is slow. Use the \"library.\" That helps!", "> Use the \"library.\"\nWhich one?", "ok", "> ok\nfine", "好的", "> 好的\n谢谢", "今天很好。明天也好！再见", "> 明天也好！\n是", "One sentence which\nis wrapped here. And another\none. Last.", "> And another one.\nYes", "> slow\nNo sentence of any"]
    rows = [(1, i, "u", t) for i, t in enumerate(texts)]
    r = {x["turn"]: x["reply_to"] for x in C.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert r == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4, 6: None, 7: 6, 8: None, 9: 8, 10: None}


def test_generated_mails(spark):
    """Conversations whose messages quote parts of earlier ones, nested, wrapped anew, by sentence or whole: each reply is found."""
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for c in range(12):
        said = []  # (sentences, message)
        for turn in range(25):
            own = [f"This is sentence {k} of message {turn} in talk {c}, said by {rng.choice('abc')}." for k in range(rng.randrange(1, 5))]
            if rng.random() < 0.3:
                own.insert(1, "")  # a paragraph's end
            lines, parent = [], None
            if said and rng.random() < 0.7:
                parent = rng.randrange(len(said))
                old = [x for x in said[parent] if x]
                cut = rng.choice([old, old[:1], old[-1:], old[1:3] or old])
                quoted = " ".join(cut)
                width = rng.choice([30, 60, 500])
                words, line = quoted.split(" "), ""
                for w in words:
                    if len(line) + len(w) > width:
                        lines.append("> " + line.strip())
                        line = ""
                    line += w + " "
                lines.append("> " + line.strip())
                if parent and rng.random() < 0.5:  # what the quoted message quoted itself, deeper
                    lines.append(">> " + [x for x in said[rng.randrange(parent)] if x][0])
                if rng.random() < 0.5:
                    lines.insert(0, "On Monday Ann wrote:")
            text = "\n".join([*lines, *own]) if rng.random() < 0.5 or not lines else "\n".join([*own, "", *lines])
            said.append(own)
            want[c, turn] = parent
            rows.append((c, turn, "user", text, 1, 2))
    d = spark.createDataFrame(rows, SCHEMA + ", hash int, thread int").repartition(5)
    got = {(r["conv_id"], r["turn"]): r for r in C.report(d).collect()}
    assert {k: r["reply_to"] for k, r in got.items()} == want
    for (c, turn), r in got.items():
        depth, at = 0, turn
        while want[c, at] is not None:
            depth, at = depth + 1, want[c, at]
        assert (r["thread"], r["depth"]) == (at, depth) and ">" not in r["text"] and f"of message {turn} in talk" in r["text"]


def test_very_long_message(spark):
    rows = [(1, 0, "u", "One long line. " * 50_000), (1, 1, "u", "> One long line.\n" * 20_000 + "yes"), (1, 2, "u", ">" * 100_000)]
    r = {x["turn"]: x for x in C.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert r[1]["reply_to"] == 0 and r[1]["text"] == "yes" and r[2]["reply_to"] is None
