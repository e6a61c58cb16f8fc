from pyspark.sql import functions as F

from convlake.functions import routing
from convlake.operators import artifacts as art
from convlake.operators import results

ITEM = "conversation_id long, id long, collection string, title string, body string, operation string, status string, kind string, fingerprint string, evidence array<struct<sequence_start int, sequence_end int, text string>>, confidence double, needs_confirmation boolean"


def item(i, collection="tasks", title="Ship it", body="b", operation=None, status=None, kind=None, fingerprint=None, evidence=((1, 2, "we ship it"),)):
    return (1, i, collection, title, body, operation, status, kind, fingerprint, None if evidence is None else list(evidence), None, None)


def test_merge_items(spark):
    rows = [item(1), item(2), item(3, title="SHIP IT"), item(4, operation="NO_ACTION"), item(5, fingerprint="f"), item(6, title=None, fingerprint="f"), item(7, fingerprint=""), item(8, evidence=None), item(9, collection="issues", kind="risk"), item(10, collection="issues", kind="other")]
    df = spark.createDataFrame(rows, ITEM)
    got = results.merge_items(df, ["id"]).collect()
    assert sorted((r.section, r.id) for r in got) == [("blockers", 9), ("tasks", 1), ("tasks", 5), ("tasks", 8)]
    assert results.merge_items(df.limit(0), ["id"]).collect() == []
    late = results.carried(df.where("id = 3"), df.where("id <> 3"), ["id"]).collect()
    assert sorted(r.id for r in late) == [3, 5, 8, 9]


def test_valid_items(spark):
    rows = [item(1), item(2, title=""), item(3, evidence=()), item(4, evidence=None), item(5, collection="notes", body=""), item(6, collection="notes"), item(7, operation="NO_ACTION"), item(8, collection="decisions", body=None), item(9, collection="issues")]
    got = {r.id: (r.operation, r.confidence, r.needs_confirmation, r.status, r.kind, r.body) for r in results.valid_items(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {
        1: ("NEEDS_CONFIRMATION", 0.5, True, None, None, "b"), 6: (None, 0.5, None, None, None, "b"), 8: (None, 0.5, None, "unresolved_discussion", None, ""), 9: (None, 0.5, None, None, "open_question", "b"),
    }


def test_findings(spark):
    rows = [item(1), item(2, title="Bare", evidence=()), item(3, title="Wrong", evidence=((1, 1, "never said"), (2, 2, "We SHIP  it now"), (3, 3, None)))]
    spoken = spark.createDataFrame([(1, "so we ship it now", "so we ship it now"), (2, None, "We need to call them")], "conversation_id long, raw string, normalized string")
    got = sorted(((r.conversation_id, r.code, r.title) for r in results.findings(spark.createDataFrame(rows, ITEM), spoken).collect()), key=str)
    wrong = (1, "EVIDENCE_TEXT_NOT_EXACT_MATCH", "Wrong")
    assert got == sorted([(1, "MISSING_EVIDENCE", "Bare"), wrong, wrong, (2, "ACTION_WITHOUT_TASK", None)], key=str)


def test_repair_windows(spark):
    kind = "conversation_id long, window_index int, id long, position long, artifact_type string, title string, content string, owner string, operation string, identity_key string"
    row = lambda i, w, title: (1, w, i, i, "task", title, "", None, None, f"k{title}")
    existing = spark.createDataFrame([row(1, 0, "Deploy the billing service")], kind)
    incoming = spark.createDataFrame([row(1, 0, "Deploy the billing service"), row(2, 1, "Deploy billing service"), row(3, 1, "Paint a fence"), row(4, 2, "Paint a fence")], kind)
    windows = spark.createDataFrame([(1, 0, 1, True), (1, 1, 2, True), (1, 2, 0, False)], "conversation_id long, window_index int, expected int, saved boolean")
    got = {r.id: (r.resolution, r.matched_id) for r in results.repair_windows(windows, existing, incoming).collect()}
    assert got == {"2": ("DUPLICATE", "1"), "3": ("NEW", None)}


def test_publish(spark):
    target = spark.createDataFrame([("a", 1, 1, "fa", 0, "old"), ("b", 1, 1, None, 0, "old")], "id string, user_id int, space_id int, fingerprint string, created_at int, status string")
    rows = [
        ("s1", "a", 1, "x", None, "first", 1), ("s2", " a ", 1, "x", None, "second", 2), ("s3", "b", 2, "x", None, "other user", 3), ("s4", None, 1, "fa", None, "known", 4),
        ("s5", None, 1, "n", None, "new", 5), ("s6", "", 1, "n", None, "again", 6), ("s7", None, 1, None, None, "bare", 7), ("s8", None, 1, "", None, "bare", 8), ("s9", None, 1, "z", "NO_ACTION", "none", 9),
    ]
    staged = spark.createDataFrame(rows, "id string, existing_id string, user_id int, fingerprint string, operation string, status string, n int").withColumn("space_id", F.lit(1)).withColumn("created_at", F.lit(5))
    got = {r.id: (r.fingerprint, r.created_at, r.status) for r in results.publish(target, staged, ["n"]).collect()}
    assert got == {"a": ("x", 0, "second"), "b": (None, 0, "old"), "s5": ("n", 5, "new"), "s7": (None, 5, "bare"), "s8": ("", 5, "bare")}


def test_options(spark):
    options = spark.createDataFrame([(1, 1, "Home", "h"), (1, 2, "2", "w"), (1, 3, None, "home")], "u int, index int, label string, value string")
    replies = spark.createDataFrame([(1, 1, " 2 "), (1, 2, "HOME"), (1, 3, "w"), (1, 4, "9"), (1, 5, None), (2, 6, "1"), (1, 7, "")], "u int, r int, selection string")
    got = {x.r: x.option for x in routing.resolve_options(replies, options, ["u"], "r").collect()}
    assert got == {1: "w", 2: "h", 3: "w", 4: None, 5: None, 6: None, 7: None}


def test_questions_and_providers(spark):
    q = spark.createDataFrame([(1, "Show tasks for  Space 12 now"), (2, "workspace 3"), (3, "in 7 spaces"), (4, None), (5, " 42 ")], "id int, q string")
    got = {r.id: tuple(r)[1:] for r in q.select("id", routing.inline_space("q"), routing.without_inline_space("q"), routing.is_option_reply("q")).collect()}
    assert got == {1: ("12", "Show tasks now", False), 2: ("3", "", True), 3: (None, "in 7 spaces", False), 4: (None, "", False), 5: (None, "42", True)}
    two = F.array(F.lit("sarvam"), F.lit("groq"))
    row = q.limit(1).select(routing.candidates(F.lit("chat_answer"), two), routing.candidates(F.lit(None).cast("string"), two), routing.candidates(F.lit("fallback"), two)).first()
    assert list(row) == [["groq", "sarvam"], ["groq", "sarvam"], ["sarvam"]]


def test_memory_context_against_plain_python(spark):
    texts = ["Deploy the billing service", "Paint the garden fence", "Review billing rules", "Call the bank", "Order new chairs", "Plan the offsite", "Fix the billing bug", "Write the report", "Feed the fish"]
    topics = ["billing", "home", "billing", "money", None, "team", "bugs", "team", "home"]
    arts = spark.createDataFrame([(1, i, i, t, "", p) for i, (t, p) in enumerate(zip(texts, topics, strict=True))], "conversation_id long, id long, position long, title string, content string, topic string")
    asked = [(1, 100, "the billing service", "Billing "), (1, 101, "nothing here", None), (2, 102, "the billing service", "billing")]
    got = art.memory_context(spark.createDataFrame(asked, "conversation_id long, query_id long, text string, topic string"), arts, most=7, recent=3).orderBy("query_id", "rank").collect()
    for c, query, text, topic in asked:
        words, want = {w for w in text.lower().split() if len(w) > 2}, []
        for i, t in enumerate(texts if c == 1 else []):
            own = {w for w in t.lower().split() if len(w) > 2}
            score = len(words & own) / max(len(own), 1) + 0.4 * bool(topic and topics[i] == topic.strip().lower())
            if score > 0:
                want.append((-score, i))
        ids = [i for _, i in sorted(want)]
        ids += [i for i in range(len(texts) - 1, len(texts) - 4, -1) if c == 1 and i not in ids]
        assert [r.id for r in got if r.query_id == query] == ids[:7]


def test_memory_context_by_kind_status_and_topic(spark):
    rows = [
        (1, 0, 0, "task", "Paint the fence", "", "home", None), (1, 1, 1, "note", "Billing rules", "", None, None), (1, 2, 2, "note", "Billing scrapped", "", None, "rejected"), (1, 3, 3, "note", "Nothing near", "", "billing desk", None),
        (1, 4, 4, "decision", "Rent chairs", "", None, "provisional"), (1, 5, 5, "question", "Who drives", "", None, None), (1, 6, 6, "blocker", "Rain", "", None, None), (1, 7, 7, "note", "Lunch", "", None, None),
        (2, 8, 0, "note", "Lunch", "", None, None), (2, 9, 1, "note", "Dinner", "", None, "merged"),
    ]
    arts = spark.createDataFrame(rows, "conversation_id long, id long, position long, artifact_type string, title string, content string, topic string, status string")
    asked = spark.createDataFrame([(1, 100, "billing", None), (2, 101, "billing", None)], "conversation_id long, query_id long, text string, topic string")
    got = art.memory_context(asked, arts).orderBy("query_id", "rank").collect()
    # a half and a quarter of the words, then kinds alone; six are found, so no recent ones; the second conversation is filled up
    assert [(r.id, round(r.score, 6)) for r in got if r.query_id == 100] == [(1, 0.5), (3, 0.25), (0, 0.1), (4, 0.1), (5, 0.1), (6, 0.1)]
    assert [r.id for r in got if r.query_id == 101] == [8]
