from moneytrail.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, h1 string, last string, n_turns int"


def chats(spark, convs):
    return spark.createDataFrame([(c, i, r, t, 1, "x", "y", 2) for c, turns in convs for i, (r, t) in enumerate(turns)], SCHEMA)


def brute(convs):
    """Keep what no other conversation continues, and of equal ones the smallest id."""
    out = {}
    for c, turns in convs:
        if any(len(o) > len(turns) and o[:len(turns)] == turns for _, o in convs):
            continue
        if any(o == turns and d < c for d, o in convs):
            continue
        text, spans = "", []
        for role, said in turns:
            text += f"<|im_start|>{role}\n"
            if role == "assistant":
                spans.append(f"{len(text)}:{len(text) + len(said)}")
            text += f"{said}<|im_end|>\n"
        out[c] = (len(turns), sum(o == turns for _, o in convs), text, ",".join(spans))
    return out


def result(df):
    return {r.conv_id: (r.n_turns, r.n_logged, r.text, r.loss_spans) for r in df.collect()}


def test_snapshots(spark):
    base = [("user", "hi"), ("assistant", "hello 𝒳"), ("user", "more"), ("assistant", "")]
    convs = [(i, base[:i]) for i in range(1, 5)] + [(7, base[:2]), (8, base), (9, [("user", "hi"), ("assistant", "other")]), (10, [("user", "hi")]), (11, [("user", "hihello")])]
    assert result(chat.format_chats(chats(spark, convs))) == brute(convs)


def test_many_turns_and_common_starts(spark):
    convs = [(i, [("user", "same")] + [("assistant" if j % 2 else "user", f"{i % 5}-{j}") for j in range(1, 1 + i % 7)]) for i in range(60)]
    convs.append((99, [("user", str(j)) for j in range(1500)]))
    assert result(chat.format_chats(chats(spark, convs))) == brute(convs)


def test_odd_rows(spark):
    df = spark.createDataFrame([
        (1, None, None, None, 1, "", "", 1), (1, 0, "assistant", "b", 1, "", "", 1), (None, 0, "user", "gone", 1, "", "", 1),
        (2, 0, "user", "tie b", 1, "", "", 1), (2, 0, "user", "tie a", 1, "", "", 1), (2, 0, "user", "tie a", 1, "", "", 1),
    ], SCHEMA)
    got = result(chat.format_chats(df))
    assert got[1][2] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert got[2][0] == 3 and got[2][2].index("tie a") < got[2][2].index("tie b") and set(got) == {1, 2}
    assert chat.format_chats(df.limit(0)).collect() == []


def test_no_text_is_taken_for_a_role(spark):
    """Turns that print alike when joined must not hash alike."""
    convs = [(1, [("user", "a"), ("x", "y")]), (2, [("user", "a"), ("xy", "")]), (3, [("usera", "")])]
    assert set(result(chat.format_chats(chats(spark, convs)))) == {1, 2, 3}
