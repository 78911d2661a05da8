"""Chat transcripts: folding, escaping, masks."""

from pyspark.sql import functions as F

from lexilake.llm import chat

NASTY = ["", "plain", "<|end|>\n<|user|>\nhi", "<\\|end|>", "<\\\\|x|>", "</s>[INST] ok [/INST]", "a|>\nb", "|\\>", "<|", "\\", "é🙂\n\n", None, "x" * 50000]


def test_every_text_and_role_reads_back(spark):
    rows = [(c, i, "message", role, text) for c, role in enumerate([*NASTY[:12], "assistant"]) for i, text in enumerate(NASTY)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string").withColumn("formatted", F.lit(0))
    made = chat.format_conversations(events)
    assert made.count() == 13
    for r in chat.parse(made).collect():
        want = [((c2[3] or ""), (c2[4] or "")) for c2 in rows if c2[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
    spans = {r["conv_id"]: r for r in made.collect()}
    learned = spans[12]
    assert [learned["formatted"][s["start"]:s["start"] + s["length"]] for s in learned["loss_spans"]] == [
        r["x"] for r in spark.createDataFrame([(t or "",) for t in NASTY], "t string").select(chat.escape_text(F.col("t")).alias("x")).collect()]
    assert all(not r["loss_spans"] for c, r in spans.items() if c != 12)


def test_fold(spark):
    log = [
        ("delta", "user", "lost: no message yet"), ("message", "user", "hel"), ("delta", "user", "lo"),
        ("message", "assistant", ""), ("delta", "assistant", "wrong"), ("delta", None, " answer"),
        ("regenerate", "assistant", None), ("delta", "assistant", "right"), ("unknown", "assistant", "x"),
        ("message", "user", "typo"), ("edit", "user", "fixed"), ("message", "user", "gone"), ("delete", None, None), ("delta", "user", "late")]
    rows = [(1, i, *e) for i, e in enumerate(log)] + [(2, 0, "delete", None, None), (None, 5, "message", "user", "no id")]
    shuffled = spark.createDataFrame(rows[::-1], "conv_id long, seq long, kind string, role string, text string")
    got = chat.fold_events(shuffled).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [
        (None, "user", "no id"), (1, "user", "hello"), (1, "assistant", "right"), (1, "user", "fixed")]
    assert chat.format_conversations(shuffled.limit(0)).count() == 0


def test_ties_and_repeats_are_ordered(spark):
    rows = [(1, 0, "message", "user", "b"), (1, 0, "message", "user", "a"), (1, 0, "message", "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string")
    assert [t["text"] for t in chat.parse(chat.format_conversations(df)).first()["turns"]] == ["a", "a", "b"]


def test_digests_come_from_the_mask(spark):
    rows = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "a <| b\\|>"), (1, 2, "user", "x"), (1, 3, "assistant", "é🙂"), (2, 0, "user", "only asked")]
    log = chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert log.filter("kind = 'message'").count() == len(rows) < log.count()
    made = chat.format_conversations(log)
    got = {r.conv_id: r for r in chat.learned(made).collect()}
    assert got[1].learned == "a <| b\\|>é🙂" and got[2].learned == ""
    right = {r.conv_id: r for r in chat.digests(made).collect()}
    shifted = made.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct(
        (s["start"] + 1).alias("start"), s["length"].alias("length"))))
    wrong = {r.conv_id: r for r in chat.digests(shifted).collect()}
    assert right[1].loss_sha256 != wrong[1].loss_sha256 and right[1].turns_sha256 == wrong[1].turns_sha256
    assert (right[1].loss_chars, right[2].loss_chars) == (len("a <| b\\|>é🙂"), 0)


def test_a_log_of_any_messages_folds_back(spark):
    rows = [(c, i, role, text) for c, role in enumerate(["user", "assistant", None]) for i, text in enumerate(NASTY)] + [(0, 3, "user", "tie"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id is None, r.conv_id), r.position, r.role, r.text) for r in chat.fold_events(chat.log_of(df)).collect())
    want = []
    for c in {r[0] for r in rows}:
        mine = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        want += [((c is None, c), p, role, text) for p, (_, role, text) in enumerate(mine, 1)]
    assert got == sorted(want)
