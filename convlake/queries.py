"""The registered queries on the engine's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import repair, routing, text
from convlake.operators import artifacts as art
from convlake.operators import chunks as ch
from convlake.operators import merge, results, retrieval, windows
from convlake.plans import workspace
from convlake.sources import tables as src
from convlake.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
SMALL = windows.Sizes(target=60, most=90, overlap=10)


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def chunk_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = ch.classified(src.chunks(spark, d))
    return c.select("conversation_id", "sequence_number", "useful", "terminal", "skippable", ch.error_class(F.col("last_error")).alias("error_class"), ch.is_recoverable(F.lit("S3"), F.col("last_error")).alias("recoverable"))


def chunk_accounting(spark: SparkSession, d: str) -> DataFrame:
    return ch.accounting(src.chunks(spark, d))


def missing_sequences(spark: SparkSession, d: str) -> DataFrame:
    return ch.missing_sequences(src.chunks(spark, d))


def reachable_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ch.reachable(src.chunks(spark, d)).select("conversation_id", "sequence_number", "useful", "skippable")


def invalid_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    status = F.get(F.array(*map(F.lit, ch.STATUSES)), (F.col("event_id") % 11).cast("int"))
    return ch.invalid_transitions(e.select("event_id", "user_id", "ts", status.alias("status")), "user_id", ["ts", "event_id"]).select("event_id", "previous", "status", "valid")


def ready_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.ready_windows(src.chunks(spark, d), sizes=SMALL, final=True, gaps_are_terminal=True)


def window_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that windows own: with all gaps given up, each reachable useful chunk, once."""
    w = windows.ready_windows(src.chunks(spark, d), sizes=SMALL, final=True, gaps_are_terminal=True)
    return w.select("conversation_id", F.explode("owned").alias("sequence_number")).groupBy("conversation_id", "sequence_number").agg(F.count("*").alias("owners"))


def transcript_segments(spark: SparkSession, d: str) -> DataFrame:
    return windows.segments(src.doc_lines(spark, d).withColumnRenamed("doc_id", "conversation_id"), target=250, most=None)


def normalized_lines(spark: SparkSession, d: str) -> DataFrame:
    return windows.normalized_lines(src.chunks(spark, d))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return windows.transcript(src.chunks(spark, d))


def speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    return windows.speaker_turns(src.words(spark, d).withColumnRenamed("turn", "message"), ["conv_id", "message"])


def speech_quality(spark: SparkSession, d: str) -> DataFrame:
    q = windows.speech_quality(src.words(spark, d), ["conv_id", "turn"])
    return q.withColumn("speakers", F.array_join(F.transform("speakers", lambda s: s.cast("string")), ","))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    p = src.table(spark, d, "part")
    return p.select(
        "p_partkey", text.stable_hash("p_name", "p_brand", "p_type").alias("fingerprint"),
        text.identity_key(F.lit("c1"), F.lit("task"), F.col("p_name"), F.col("p_brand")).alias("identity"), text.short_id(F.lit("staged"), "p_partkey", "p_name").alias("id"),
    )


def best_matches(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d)
    return art.best_match(a.where("id % 2 = 1"), a.where("id % 2 = 0"))


def extracted_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Extraction results made from `conversations`, flattened to artifacts."""
    c = src.table(spark, d, "conversations")
    e = F.array(F.struct(F.col("turn").cast("int").alias("sequence_start"), F.col("turn").cast("int").alias("sequence_end"), F.left("text", F.lit(40)).alias("text")))
    none = F.lit(None).cast("string")
    title, body = F.left(F.trim("text"), F.lit(60)), F.left("text", F.lit(200))
    both = [title.alias("title"), body.alias("body"), F.lit(0.8).alias("confidence"), e.alias("evidence")]
    pick = lambda n, s: F.when(F.col("turn") % 4 == n, F.array(s)).otherwise(F.slice(F.array(s), 1, 0))
    result = F.struct(
        F.array(F.col("role")).alias("topics"),
        pick(0, F.struct(*both, F.lit("CREATE").alias("operation"), F.col("role").alias("owner"), none.alias("due"))).alias("tasks"),
        pick(1, F.struct(*both)).alias("notes"),
        pick(2, F.struct(*both, F.when(F.col("conv_id") % 2 == 0, "idea").otherwise("final").alias("status"))).alias("decisions"),
        pick(3, F.struct(*both, F.when(F.col("conv_id") % 2 == 0, "missing_information").otherwise("risk").alias("kind"))).alias("issues"),
        pick(0, F.left("text", F.lit(90))).alias("important_facts"),
        pick(1, F.left("text", F.lit(90))).alias("open_questions"),
    )
    w = c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("int").alias("window_index"), F.col("turn").cast("int").alias("sequence_start"), F.col("turn").cast("int").alias("sequence_end"), "text", result.alias("result"))
    return art.from_extraction(w).select("conversation_id", "window_index", "artifact_type", "title", "confidence", "topic", "identity_key")


def resolved_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts, and the artifacts left at the end."""
    k = F.col("sequence_start")
    a = src.artifacts(spark, d).withColumn("evidence", F.array(F.struct(k, "sequence_end", F.col("title").alias("text"))))
    return art.resolve_all(a.withColumn("identity_key", text.identity_key(F.col("conversation_id"), F.col("artifact_type"), F.col("title"), F.col("owner"))))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d)
    w = a.select("conversation_id", "window_index").distinct().withColumn("token_count", F.lit(10)).withColumn("non_empty_chunk_count", F.lit(1))
    weak = art.weak_windows(w, a.where("id % 7 < 2 and window_index < 4"))
    return art.coverage(a, a.where("id % 10 = 3").select("conversation_id", "title"), w, weak)


def weak_windows(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d)
    some = F.max(F.when(F.col("id") % 5 == 0, F.col("title")).otherwise("")).alias("text")
    w = a.groupBy("conversation_id", "window_index").agg(F.sum(F.length("title")).alias("token_count"), F.count_if(F.col("id") % 3 == 0).alias("non_empty_chunk_count"), some, F.count_if((F.col("id") % 7 == 0) & (F.col("conversation_id") % 3 == 0)).alias("extracted"))
    return art.weak_windows(w, a.where("id % 40 = 0")).select("conversation_id", "window_index", "token_count")


def meeting_memory(spark: SparkSession, d: str) -> DataFrame:
    return art.meeting_memory(src.artifacts(spark, d), most=5).withColumn("titles", F.array_join("titles", "|"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d)
    w = a.groupBy("conversation_id", "window_index").agg(F.max("sequence_end").alias("sequence_end"), F.array_sort(F.collect_set("topic")).alias("topics"))
    return art.topics(w, a)


def memory_context(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d)
    q = a.where("id % 20 = 0").select("conversation_id", F.col("id").alias("query_id"), F.concat_ws(" ", "title", "content").alias("text"), "topic")
    return art.memory_context(q, a).select("conversation_id", "query_id", "id", F.round("score", 6).alias("score"), "rank")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = src.table(spark, d, "documents")
    out = docs.select("doc_id", F.posexplode(text.fixed_chunks("text")).alias("chunk_index", "text"))
    return out.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


def rule_signals(spark: SparkSession, d: str) -> DataFrame:
    docs = src.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.size(text.action_signals("text")).alias("signals"), F.size(text.entities("text")).alias("entities"), text.looks_actionable("text").alias("actionable"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = src.table(spark, d, "documents")
    return docs.select("doc_id", text.estimate_tokens("text").alias("tokens"), text.rough_tokens("text").alias("rough"), F.size(text.query_terms("text")).alias("terms"))


def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn held against the next one."""
    c = src.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("following"))
    pairs = c.join(nxt, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", text.evidence_found("text", "following").alias("found"), text.lexical_overlap("text", "following").alias("overlap"), F.round(text.title_jaccard("text", "following"), 6).alias("jaccard"))


def top_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.top_k(q, e).select("query_id", "rank", "id", "score")


def retrieved_context(spark: SparkSession, d: str) -> DataFrame:
    """Hits, their neighbours and the final ranking: vector vec_id stands for chunk vec_id % 3 of document vec_id."""
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    docs = src.table(spark, d, "documents")
    parts = docs.select(F.col("doc_id").alias("job_id"), F.posexplode(text.fixed_chunks("text")).alias("chunk_index", "text"))
    hits = retrieval.top_k(q, e).select("query_id", F.col("id").alias("job_id"), (F.col("id") % 3).cast("int").alias("chunk_index"), "score")
    hits_text = hits.join(parts, ["job_id", "chunk_index"])
    both = retrieval.merged(hits_text, retrieval.neighbours(hits, parts))
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    out = retrieval.ranked(both, asked)
    return out.select("query_id", "rank", "job_id", "chunk_index", "is_parent", F.round("score", 6).alias("score"), "lexical")


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 20."""
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.top_k(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), e).select("query_id", "rank", "id", "score")


def vector_searches(spark: SparkSession, d: str) -> DataFrame:
    return _searches(spark, d)


def label_searches(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of one's own label: a search that is pruned by a key."""
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return retrieval.top_k(e.where("id % 20 = 0").select("label", F.col("id").alias("query_id"), "vector"), e, keys=("label",))


def searched_context(spark: SparkSession, d: str) -> DataFrame:
    """As retrieved_context, but for every search, and vector vec_id stands for chunk vec_id modulo the chunks of document vec_id."""
    docs = src.table(spark, d, "documents")
    chunks = docs.select("doc_id", "text", text.fixed_chunks("text").alias("chunks"))
    parts = chunks.select(F.col("doc_id").alias("job_id"), F.posexplode("chunks").alias("chunk_index", "text"))
    sizes = chunks.select(F.col("doc_id").alias("id"), F.size("chunks").alias("n")).where("n > 0")
    hits = _searches(spark, d).join(sizes, "id").select("query_id", F.col("id").alias("job_id"), (F.col("id") % F.col("n")).cast("int").alias("chunk_index"), "score")
    both = retrieval.merged(hits.join(parts, ["job_id", "chunk_index"]), retrieval.neighbours(hits, parts))
    out = retrieval.ranked(both, docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")))
    return out.select("query_id", "rank", "job_id", "chunk_index", "is_parent", F.round("score", 6).alias("score"), "lexical")


def routed_events(spark: SparkSession, d: str) -> DataFrame:
    return ev.routed(src.envelopes(spark, d)).select("event_id", "event_type", "stream", "accepted")


def accepted_once(spark: SparkSession, d: str) -> DataFrame:
    return ev.accept_once(src.envelopes(spark, d)).select("idempotency_key", "event_id")


def failure_routes(spark: SparkSession, d: str) -> DataFrame:
    out = ev.after_failure(ev.parsed(src.envelopes(spark, d)))
    return out.select("event_id", "readable", "route", "next_attempt", stamp("not_before").alias("not_before"))


def inactive_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = ev.inactive_sessions(src.envelopes(spark, d), "user_id")
    return out.select("user_id", stamp("begin").alias("begin"), stamp("last_at").alias("last_at"), "events")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_type").alias("provider"), F.col("event_id").alias("request_id"), at.alias("at"), (F.col("event_id") % 900 + 100).alias("tokens"))


def admitted_requests(spark: SparkSession, d: str) -> DataFrame:
    return ev.admitted(_requests(spark, d), "provider", rpm=3, rpd=900, tpm=2000)


def offered_load(spark: SparkSession, d: str) -> DataFrame:
    return ev.offered_load(_requests(spark, d), "provider").select("request_id", "requests", "load")


def first_success(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events").where("event_type is not null")
    i = F.col("event_id")
    a = e.select(F.floor(i / 4).alias("call_id"), (i % 4).alias("ord"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("provider"), (F.col("user_id") % 3 == 0).alias("ok"), ch.is_retryable_status(F.get(F.array(*map(F.lit, [400, 503, 429])), (F.col("user_id") % 3).cast("int"))).alias("retryable"))
    return ev.first_success(a, "call_id")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    o, c = src.table(spark, d, "orders"), src.table(spark, d, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "pending").otherwise("in_progress")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"), F.col("c_nationkey").alias("space_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("due_text"))


def space_stats(spark: SparkSession, d: str) -> DataFrame:
    return workspace.space_stats(_tasks(spark, d)).withColumn("last_update", stamp("last_update"))


def active_tasks(spark: SparkSession, d: str) -> DataFrame:
    return workspace.active_tasks(_tasks(spark, d)).select("space_id", "rank", "task_id", "status")


def due_tasks(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1995-03-15").cast("date")
    t = _tasks(spark, d).withColumn("resolved", F.to_date("updated_at"))
    line = workspace.task_line(F.col("task_id").cast("string"), F.col("status"), workspace.due_display(F.col("resolved"), F.lit(None).cast("date"), F.col("due_text")))
    return t.where(workspace.is_due(F.col("resolved"), F.col("due_text"), day, "today")).select("task_id", line.alias("line"))


def task_page(spark: SparkSession, d: str) -> DataFrame:
    return merge.page(_tasks(spark, d), "updated_at", "task_id", 50, ("1997-01-01 00:00:00", 5000)).select("task_id", stamp("updated_at").alias("updated_at"))


def space_list(spark: SparkSession, d: str) -> DataFrame:
    found = _tasks(spark, d).select("space_id").distinct()
    n = src.table(spark, d, "nation")
    labels = n.select(F.col("n_nationkey").alias("space_id"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.col("n_name")).alias("name"), F.lit(None).cast("string").alias("title"))
    return workspace.spaces(found, labels)


def latest_orders(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders")
    return merge.latest_wins(o.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).withColumn("o_orderdate", stamp("o_orderdate"))


def upserted_orders(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    new = o.where(k % 3 == 0).select((k + k % 2 * 1_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return merge.upsert(o, new, ["o_orderkey"], ["o_custkey"])


def inserted_orders(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return merge.insert_absent(o.where("o_orderkey % 2 = 0"), o, ["o_orderkey"], ["o_custkey"])


def last_messages(spark: SparkSession, d: str) -> DataFrame:
    c = src.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return merge.last_rows(c, ["conv_id"], ["turn"], 4)


def key_sources(spark: SparkSession, d: str) -> DataFrame:
    named = {"customer": src.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), "supplier": src.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "nation": src.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))}
    return merge.distinct_sources(named, "k").withColumn("sources", F.array_join("sources", ","))


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    c = src.table(spark, d, "customer")
    i = F.col("c_custkey")
    cursor = text.encode_cursor(F.lit("2024-01-01"), i)
    return c.select("c_custkey", text.object_key(F.col("c_name"), F.col("c_mktsegment"), i.cast("string"), i % 1000, F.lit("part 1.webm")).alias("object_key"), text.job_id(i.cast("string"), (i % 7).cast("string"), F.lit("c")).alias("job_id"), text.fallback_label("c_name").alias("label"), text.decode_cursor(cursor)["key"].alias("cursor_key"))


def question_plans(spark: SparkSession, d: str) -> DataFrame:
    c = src.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(text.tool_focus("text"), ",").alias("focus"), text.temporal_scope("text").alias("scope"))


def repaired_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents decoded with the wrong codec, and repaired."""
    docs = src.table(spark, d, "documents")
    wrong = F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", F.md5(repair.repair_text(wrong).cast("binary")).alias("md5"))


def json_objects(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    return e.select("event_id", F.get_json_object(repair.json_object(F.concat(F.lit("```json\nnoise {x "), F.col("props"), F.lit(" }```"))), "$.k").cast("int").alias("k"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Extraction items from the artifacts of `part`: some without title, body, evidence or confidence, some that repeat, by key."""
    i, k = F.col("id"), F.col("artifact_type")
    collection = F.when(k.isin("task", "follow_up"), "tasks").when(k.isin("note", "fact"), "notes").when(k.isin("decision", "idea"), "decisions").otherwise("issues")
    span = F.array(F.struct("sequence_start", "sequence_end", F.col("title").alias("text")))
    return src.artifacts(spark, d).select(
        "conversation_id", "id", "window_index", collection.alias("collection"), F.when(i % 31 != 0, F.col("title")).alias("title"), F.when(i % 7 != 0, F.col("content")).alias("body"),
        F.when(i % 29 == 0, "NO_ACTION").otherwise(F.col("operation")).alias("operation"), F.when(k == "idea", "idea").alias("status"),
        F.when(k == "question", "open_question").when(k.isin("risk", "blocker"), k).alias("kind"), F.when(i % 3 == 0, F.lower("title")).alias("fingerprint"),
        F.when(i % 11 != 0, span).otherwise(F.slice(span, 1, 0)).alias("evidence"), F.when(i % 5 != 0, i % 10 / 10).alias("confidence"), F.lit(None).cast("boolean").alias("needs_confirmation"),
    )


def merged_items(spark: SparkSession, d: str) -> DataFrame:
    return results.merge_items(_items(spark, d), ["window_index", "id"]).select("conversation_id", "section", "id")


def carried_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of the last window, and those that only the others have."""
    i = _items(spark, d)
    return results.carried(i.where("window_index = 4"), i.where("window_index < 4"), ["window_index", "id"]).select("conversation_id", "section", "id")


def valid_items(spark: SparkSession, d: str) -> DataFrame:
    return results.valid_items(_items(spark, d)).select("conversation_id", "id", "collection", "body", "operation", "confidence", "needs_confirmation", "status", "kind")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    i, n, zero = F.col("conv_id"), F.col("turn"), F.lit(0)
    some = {"tasks": (i + n) % 3 == 0, "notes": n % 4 == 1, "decisions": i % 5 == 0, "facts": n % 2 == 1}
    return src.table(spark, d, "conversations").select("conv_id", "turn", "text", F.left("text", F.lit(150)).alias("summary"), *[v.cast("int").alias(k) for k, v in some.items()], zero.alias("issues"), zero.alias("topics"), zero.alias("questions"))


def window_recovery(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("conv_id", "turn", results.needs_window_recovery(F.col("text")).alias("needs_recovery"))


def final_recovery(spark: SparkSession, d: str) -> DataFrame:
    windows_, i = _outcomes(spark, d), F.col("conv_id")
    final = windows_.select("conv_id").distinct().select("conv_id", (i % 4 == 0).cast("int").alias("tasks"), (i % 3 == 0).cast("int").alias("notes"), F.lit(0).alias("decisions"), F.lit(0).alias("issues"))
    return results.needs_final_recovery(windows_, final, "conv_id")


def unsaved_windows(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d)
    w = a.groupBy("conversation_id", "window_index").agg(F.count_if(F.col("status") != "rejected").alias("expected")).withColumn("saved", (F.col("conversation_id") + F.col("window_index")) % 4 != 1)
    return results.unsaved_windows(w, a.where("window_index < 3 or id % 40 = 0")).select("conversation_id", "window_index", "expected")


def item_findings(spark: SparkSession, d: str) -> DataFrame:
    """Items held against transcripts made of three quarters of the titles; conversations with an even number have no tasks."""
    raw = F.array_join(F.sort_array(F.collect_list(F.when(F.col("id") % 4 < 3, F.col("title")))), " ")
    t = src.artifacts(spark, d).groupBy("conversation_id").agg(raw.alias("raw"))
    t = t.withColumn("normalized", F.when(F.col("conversation_id") % 4 < 2, F.concat(F.lit("we need to "), "raw")).otherwise(F.col("raw")))
    return results.findings(_items(spark, d).where("collection <> 'tasks' or conversation_id % 2 = 1"), t)


def published_tasks(spark: SparkSession, d: str) -> DataFrame:
    o, k = src.table(spark, d, "orders"), F.col("o_orderkey")
    mark = lambda x: F.concat(F.lit("f"), x.cast("string")).alias("fingerprint")
    user = F.col("o_custkey").alias("user_id")
    target = o.where(k % 2 == 0).select(k.cast("string").alias("id"), user, F.lit(0).alias("space_id"), mark(k), F.lit(1).alias("created_at"), F.col("o_orderstatus").alias("status"))
    staged = o.where(k % 3 == 0).select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(k % 5 == 0, k.cast("string")).alias("existing_id"), user, F.lit(0).alias("space_id"), mark(k % 5000),
        F.when(k % 7 == 0, "NO_ACTION").alias("operation"), F.lit(2).alias("created_at"), F.lit("staged").alias("status"), k.alias("n"),
    )
    return results.publish(target, staged, ["n"]).drop("space_id")


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def attempt_statuses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    message = F.when(i % 6 == 0, "The API key is not configured").otherwise("timed out")
    return src.table(spark, d, "events").select("event_id", routing.attempt_status(_pick(["ok", "permanent", "temporary", "other"], i % 4), F.col("user_id") % 3, message).alias("status"))


def candidate_orders(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    configured = F.array_compact(F.array(*[F.when(F.floor(i / (8 << n)) % 2 == 1, F.lit(p)) for n, p in enumerate(["gemini", "groq", "mistral", "sarvam"])]))
    return src.table(spark, d, "events").select("event_id", F.array_join(routing.candidates(_pick([*routing.CANDIDATES, "unknown"], i % 8), configured), ",").alias("providers"))


def storage_errors(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    code = _pick([*routing.PERMANENT_CODES, *routing.TEMPORARY_CODES, "Other", ""], F.floor(i / 4) % 10)
    return src.table(spark, d, "events").select("event_id", routing.storage_error(_pick(["credentials", "timeout", "client", "none"], i % 4), code, _pick([400, 403, 404, 409, 500, 503], F.floor(i / 40) % 6)).alias("class"))


def space_selection(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn").cast("string")
    named = _pick(["", " in space ", " for Workspace ", " of PROJECT "], F.col("turn") % 4)
    question = F.concat(F.col("text"), named, F.when(named != "", n).otherwise(""), F.lit(" please"))
    reply = F.when(F.col("turn") % 3 == 0, n).when(F.col("turn") % 3 == 1, F.concat(F.lit("Space "), n)).otherwise(F.col("text"))
    return src.table(spark, d, "conversations").select("conv_id", "turn", routing.inline_space(question).alias("space"), routing.without_inline_space(question).alias("question"), routing.is_option_reply(reply).alias("is_reply"))


def chosen_options(spark: SparkSession, d: str) -> DataFrame:
    n = src.table(spark, d, "nation")
    by = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    options = n.select(F.col("n_regionkey").alias("region"), F.row_number().over(by).alias("index"), F.col("n_name").alias("label"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("value"))
    i = F.col("c_custkey")
    said = F.when(i % 3 == 0, F.concat(F.lit(" 0"), (i % 8).cast("string"))).when(i % 3 == 1, F.lower("n_name")).otherwise(F.concat(F.lit("V"), (i % 25).cast("string")))
    c = src.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return routing.resolve_options(c.select((i % 5).cast("int").alias("region"), "c_custkey", said.alias("selection")), options, ["region"], "c_custkey")


def queries() -> dict[str, Query]:
    found = [
        chunk_accounting, chunk_predicates, missing_sequences, reachable_chunks, invalid_transitions, ready_windows, window_ownership, transcript_segments, normalized_lines, transcripts,
        speaker_turns, speech_quality, fingerprints, best_matches, extracted_artifacts, resolved_artifacts, coverage, weak_windows, meeting_memory, topics, memory_context,
        document_chunks, rule_signals, token_counts, evidence_checks, top_vectors, retrieved_context, routed_events, accepted_once, failure_routes, inactive_sessions,
        admitted_requests, offered_load, first_success, space_stats, active_tasks, due_tasks, task_page, space_list, latest_orders, upserted_orders, inserted_orders, last_messages,
        key_sources, object_keys, question_plans, repaired_text, json_objects,
        merged_items, carried_items, valid_items, window_recovery, final_recovery, unsaved_windows, item_findings, published_tasks, attempt_statuses, candidate_orders, storage_errors,
        space_selection, chosen_options, vector_searches, label_searches, searched_context,
    ]
    return {f.__name__: f for f in found}
