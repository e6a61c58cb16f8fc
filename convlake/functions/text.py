"""Text functions as Column expressions: normalising, tokens, signals, fingerprints, similarity, chunking, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that signal an action (English, Hinglish, Hindi), in order.
ACTION_PATTERNS = [
    r"\bwill\b", r"\bmust\b", r"\bneed to\b", r"\bshould\b", r"\bplease\b", r"\bremind\b", r"\bfollow up\b", r"\bassigned\b", r"\bresponsible\b",
    r"\bcompleted\b", r"\bcancelled\b", r"\bblocked\b", r"\bpending\b", r"\btomorrow\b", r"\bfriday\b", r"\bnext week\b", r"\bdeadline\b",
    r"\bdecided\b", r"\bagreed\b", r"\bkarna hai\b", r"\bkal\b", r"\bzimmedar\b", r"\bpoora ho gaya\b", r"\bफॉलो अप\b", r"\bकल\b", r"\bपूरा\b", r"\bअटका\b",
]
# Entity patterns, in order: email, url, phone, currency, percentage.
ENTITY_PATTERNS = [r"[\w.+-]+@[\w-]+\.[\w.-]+", r"https?://\S+", r"\+?\d[\d\s-]{7,}\d", r"(?:₹|rs\.?|inr|\$)\s?\d+(?:[\d,]*)(?:\.\d+)?", r"\b\d+(?:\.\d+)?%"]
# Words that titles are compared without.
STOPWORDS = "the a an to for of and or on in at we let lets need needs should must please this that with from into our it is be do then first also".split()
# Verbs that name an action.
ACTION_VERBS = (
    "add download build test deploy host move check fix update create configure install review send call schedule prepare write document "
    "migrate replace remove delete verify validate release publish monitor investigate assign confirm complete finish cancel start"
).split()
# Substrings that make a text look actionable.
ACTIONABLE = ["will", "should", "need to", "needs to", "must", "tomorrow", "today", "deadline", "deploy", "fix", "send", "call", "schedule", "decide", "agreed", "requirement", "follow up", "follow-up", "?"]
# Headings at which a public answer ends.
ANSWER_ENDS = ["source", "sources", "evidence", "context", "references", "retrieved context"]

SPACE = r"(?U)\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # what SPACE stands for


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row: what stands inside a lambda is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space at either end; null is empty."""
    return F.btrim(text_or_empty(x), F.lit(WHITE))


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(x), SPACE, " "))


def words(x: Column | str) -> Column:
    """White-space words of a text, in order."""
    return F.filter(F.split(collapse(x), " "), lambda w: w != "")


def estimate_tokens(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.size(words(x)))


def rough_tokens(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text_or_empty(x)) / 4).cast("int"))


def sentences(x: Column | str) -> Column:
    return F.split(strip(x), r"(?U)(?<=[.!?।])\s+")


def line_sequence(x: Column | str) -> Column:
    """The number in a leading [n], else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text_or_empty(x), r"^\[(\d+)\]", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))


def cut_overlap(x: Column | str, previous: Column | str, least: int = 8, most: int = 80, window: int = 120) -> Column:
    """The collapsed text without its longest beginning (least to most characters) that the end of the previous text holds.

    Every shorter beginning of a match matches as well, so the longest match is the number of matching lengths.
    """
    text = collapse(x)
    tail = F.lower(F.substring(text_or_empty(previous), -window, window))
    size = F.least(F.lit(most), F.length(text))
    sizes = F.when(size >= least, F.sequence(F.lit(least), size)).otherwise(F.array().cast("array<int>"))
    found = F.array_max(F.filter(sizes, lambda k: F.contains(tail, F.lower(F.left(text, k)))))
    rest = F.regexp_replace(F.substr(text, F.coalesce(found, F.lit(0)) + 1), r"^[ ,.\-]+", "")
    return F.when(found.isNull(), text).otherwise(rest)


def fixed_chunks(x: Column | str, size: int = 900, overlap: int = 150) -> Column:
    """Chunks of `size` characters every size - overlap of the text without white space at its ends, each without white space at its
    own; blank ones go before the rest are numbered by their place.

    One pass parts the text into steps, and a chunk is a step and the beginning of what follows, so time grows with the length.
    """
    step = size - overlap
    reach = -(-size // step)
    steps = F.regexp_extract_all(strip(x), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    chunk = lambda s: lambda _, i: strip(F.left(F.array_join(F.slice(s, i + 1, reach), ""), F.lit(size)))
    return F.filter(let(steps, lambda s: F.transform(s, chunk(s))), lambda t: t != "")


# --- fingerprints


def fingerprint_text(x: Column | str) -> Column:
    return F.lower(collapse(x))


def stable_hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *map(fingerprint_text, parts)), 256)


def evidence_range(evidence: Column) -> Column:
    """min(start):max(end) of an array of evidence spans; empty if there is none."""
    low, high = F.array_min(F.transform(evidence, lambda e: e.sequence_start)), F.array_max(F.transform(evidence, lambda e: e.sequence_end))
    return F.when(low.isNull(), F.lit("")).otherwise(F.concat_ws(":", low, high))


def task_fingerprint(space: Column, title: Column, body: Column, owner: Column, due: Column, span: Column) -> Column:
    return stable_hash(space, title, F.left(text_or_empty(body), F.lit(512)), owner, due, span)


def note_fingerprint(space: Column, title: Column, body: Column, span: Column) -> Column:
    return stable_hash(space, title, F.left(text_or_empty(body), F.lit(512)), span)


def identity_key(conversation: Column, kind: Column, title: Column, owner: Column) -> Column:
    return stable_hash(conversation, kind, title, owner)


def short_id(*parts: Column | str) -> Column:
    """24 hex digits of SHA-1 over the parts."""
    return F.left(F.sha1(F.concat_ws(":", *[text_or_empty(_c(p).cast("string")) for p in parts]).cast("binary")), F.lit(24))


# --- rule signals


def action_signals(x: Column | str) -> Column:
    """The patterns that the text has, in their order. All phrases are looked for in one pass, as none is part of another."""
    phrases = [p.removeprefix(r"\b").removesuffix(r"\b") for p in ACTION_PATTERNS]
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(x)), F.lit(r"\b(?:" + "|".join(phrases) + r")\b"), F.lit(0)))
    known = F.array(*[F.struct(F.lit(w).alias("said"), F.lit(p).alias("pattern")) for w, p in zip(phrases, ACTION_PATTERNS, strict=True)])
    return let(found, lambda f: F.transform(F.filter(known, lambda k: F.array_contains(f, k.said)), lambda k: k.pattern))


def entities(x: Column | str) -> Column:
    """All matches of each pattern, in their order. A pattern is only tried on texts that have a character it needs."""
    text, none = text_or_empty(x), F.array().cast("array<string>")
    needed = [F.contains(text, F.lit("@")), F.contains(text, F.lit("://")), text.rlike(r"\d"), text.rlike(r"\d"), F.contains(text, F.lit("%"))]
    every = [F.when(has, F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0))).otherwise(none) for has, p in zip(needed, ENTITY_PATTERNS, strict=True)]
    return F.flatten(F.array(*every))


def any_of(x: Column | str, markers: list[str]) -> Column:
    """Does the lower-cased text contain any of the markers?"""

    def holds(low: Column) -> Column:
        found = F.lit(False)
        for m in markers:
            found = found | F.contains(low, F.lit(m))
        return found

    return let(F.lower(text_or_empty(x)), holds)


def looks_actionable(x: Column | str) -> Column:
    return (F.trim(text_or_empty(x)) != "") & any_of(x, ACTIONABLE)


# --- title and text similarity


def resolver_text(x: Column | str) -> Column:
    folded = F.replace(F.lower(text_or_empty(x)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9\s]+", " "), r"\s+", " "))


def resolver_words(x: Column | str) -> Column:
    return F.filter(F.split(resolver_text(x), " "), lambda w: w != "")


def title_tokens(x: Column | str) -> Column:
    return F.array_except(resolver_words(x), F.array(*map(F.lit, STOPWORDS)))


def object_tokens(x: Column | str) -> Column:
    return F.array_except(title_tokens(x), F.array(*map(F.lit, ACTION_VERBS)))


def primary_verb(x: Column | str) -> Column:
    """The first action verb, else the first word, else null."""
    found = resolver_words(x)
    return F.coalesce(F.get(F.filter(found, lambda w: w.isin(ACTION_VERBS)), F.lit(0)), F.get(found, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def title_jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = title_tokens(a), title_tokens(b)
    same = (resolver_text(a) == resolver_text(b)) & (resolver_text(a) != "")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.when(same, 1.0).otherwise(0.0)).otherwise(jaccard(x, y))


def object_jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = object_tokens(a), object_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def memory_tokens(x: Column | str) -> Column:
    return F.array_distinct(F.filter(words(F.lower(text_or_empty(x))), lambda w: F.length(w) > 2))


def retrieval_tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(x)), F.lit(r"(?U)\w+"), F.lit(0))


def query_terms(x: Column | str) -> Column:
    return F.array_distinct(F.filter(retrieval_tokens(x), lambda w: F.length(w) > 2))


def lexical_overlap(query: Column | str, x: Column | str) -> Column:
    return F.size(F.array_intersect(query_terms(query), retrieval_tokens(x)))


def evidence_found(quote: Column | str, x: Column | str, gram: int = 4) -> Column:
    """Is the quote, or any `gram` of its words in a row, in the text (case and white space aside)? Longer runs imply shorter ones."""
    q, t = F.lower(collapse(quote)), F.lower(collapse(x))
    w = F.split(q, " ")
    at = F.when(F.size(w) >= gram, F.sequence(F.lit(1), F.size(w) - gram + 1)).otherwise(F.array().cast("array<int>"))
    return (q != "") & (F.contains(t, q) | F.exists(at, lambda i: F.contains(t, F.array_join(F.slice(w, i, F.lit(gram)), " "))))


def richer(current: Column | str, incoming: Column | str) -> Column:
    """The incoming content if there is no current one, or it is as long or longer, or it adds words; else the current one."""
    a, b = text_or_empty(current), text_or_empty(incoming)
    better = (F.trim(b) != "") & ((F.trim(a) == "") | (F.length(b) >= F.length(a)) | (F.size(F.array_except(title_tokens(b), title_tokens(a))) > 0))
    return F.when(better, b).otherwise(a)


def merge_evidence(a: Column, b: Column, most: int = 8) -> Column:
    """Both arrays of evidence in order, first of each (start, end, first 80 characters of the normalised text), `most` at most."""
    both = F.concat(F.coalesce(a, F.slice(b, 1, 0)), F.coalesce(b, F.slice(a, 1, 0)))
    key = lambda e: F.concat_ws(":", e.sequence_start, e.sequence_end, F.left(resolver_text(e.text), F.lit(80)))
    keyed = F.transform(both, lambda e: F.struct(key(e).alias("key"), e.alias("item")))
    first = let(keyed, lambda k: let(k["key"], lambda keys: F.filter(k, lambda x, i: F.array_position(keys, x["key"]) == i + 1)))
    return F.slice(first["item"], 1, most)


def ring(history: Column, item: Column, most: int = 8) -> Column:
    """The last most - 1 entries and the new one."""
    return F.concat(F.slice(history, F.greatest(F.size(history) - (most - 2), F.lit(1)), F.lit(most - 1)), F.array(item))


# --- labels, keys and answers


def fallback_label(x: Column | str) -> Column:
    return F.right(F.regexp_replace(text_or_empty(x), r"[^\p{L}\p{N}]", ""), F.lit(6))


def first_filled(*parts: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_c(p)), F.lit("")) for p in parts])


def safe_part(x: Column | str) -> Column:
    return F.regexp_replace(F.trim(text_or_empty(x)), r"[^A-Za-z0-9._-]+", "_")


def object_key(user: Column, space: Column, conversation: Column, sequence: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("audio"), safe_part(user), safe_part(space), safe_part(conversation), F.concat_ws("_", F.lpad(sequence.cast("string"), 8, "0"), safe_part(name)))


def job_id(conversation: Column, sequence: Column, chunk: Column) -> Column:
    return F.concat_ws(":", conversation, sequence, chunk)


def encode_cursor(at: Column, key: Column) -> Column:
    """A page cursor: JSON in URL-safe base64."""
    return F.translate(F.base64(F.to_json(F.struct(at.alias("at"), key.alias("key"))).cast("binary")), "+/\n", "-_")


def decode_cursor(x: Column | str, kind: str = "at string, key long") -> Column:
    """The cursor's struct; null if it isn't one."""
    return F.from_json(F.try_to_binary(F.translate(_c(x), "-_", "+/"), F.lit("base64")).cast("string"), kind)


def task_status(operation: Column, needs_confirmation: Column) -> Column:
    return F.when(needs_confirmation, "needs_confirmation").when(operation == "COMPLETE", "completed").when(operation == "CANCEL", "cancelled").otherwise("pending")


def lifecycle(operation: Column) -> Column:
    return F.when(operation == "COMPLETE", "completed").when(operation == "CANCEL", "rejected").when(operation == "UPDATE", "active").otherwise("provisional")


def task_type(title: Column, due: Column, body: Column) -> Column:
    low = F.lower(text_or_empty(title))
    deadline = due.isNotNull() & F.contains(low, F.lit("deadline")) & (F.trim(text_or_empty(body)) == "")
    return F.when(deadline, "deadline").when(F.contains(low, F.lit("follow")), "follow_up").otherwise("task")


def public_answer(x: Column | str) -> Column:
    """An answer up to its list of sources, without lines of raw context."""
    lines = F.split(text_or_empty(x), r"\r?\n")
    mark = lambda s: F.regexp_replace(F.lower(F.regexp_replace(F.trim(s), r"^[*#:\- ]+|[*#:\- ]+$", "")), r":$", "")
    ends = F.array_min(F.transform(F.filter(F.transform(lines, lambda s, i: F.struct(mark(s).alias("m"), i.alias("i"))), lambda p: p.m.isin(ANSWER_ENDS)), lambda p: p.i))
    has = lambda s, m: F.contains(s, F.lit(m))
    starts = lambda s: F.startswith(s, F.lit("* [")) | F.startswith(s, F.lit("- [")) | F.startswith(s, F.lit("["))
    raw = lambda s: (has(s, "source ") & has(s, "chunk")) | (starts(s) & (has(s, "source") | has(s, "chunk")))
    kept = F.filter(F.slice(lines, F.lit(1), F.coalesce(ends, F.size(lines))), lambda s: ~raw(F.lower(F.trim(s))))
    return F.trim(F.array_join(kept, "\n"))


def temporal_scope(question: Column | str) -> Column:
    low = F.lower(text_or_empty(question))
    return F.when(F.contains(low, F.lit("today")), "today").when(F.contains(low, F.lit("tomorrow")), "tomorrow").when(F.contains(low, F.lit("all")), "all").otherwise("unspecified")


def tool_focus(question: Column | str) -> Column:
    """Which reports a question asks for, in order."""
    says = lambda *ws: any_of(question, list(ws))
    summary = says("summary", "summarize")
    parts = [(says("task", "plan"), "tasks"), (says("note"), "notes"), (summary, "summaries"), (summary, "space_memory"), (says("decision"), "decisions"), (says("issue", "risk", "blocker"), "issues")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in parts]))


def keyterms(x: Column, terms: int = 100, tokens: int = 500, words_each: int = 8) -> Column:
    """Key terms collapsed, each once whatever its case, none of more than words_each words; it ends where a term would go over
    `terms` terms or `tokens` words in all."""
    clean = F.filter(F.transform(x, collapse), lambda t: (t != "") & (F.size(F.split(t, " ")) <= words_each))
    low = F.transform(clean, F.lower)
    once = F.filter(clean, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(s: Column, t: Column) -> Column:
        n = s.n + F.size(F.split(t, " "))
        over = s["over"] | (F.size(s.got) >= terms) | (n > tokens)
        return F.struct(F.when(over, s.got).otherwise(F.concat(s.got, F.array(t))).alias("got"), F.when(over, s.n).otherwise(n).alias("n"), over.alias("over"))

    return F.aggregate(once, start, step, lambda s: s.got)


def fit_ladder(lengths: Column, limit: Column | int, ladder: tuple[int, ...] = (240, 120, 60, 40)) -> Column:
    """The first content limit of the ladder at which texts of these lengths stay within `limit` rough tokens, else its last."""
    out = F.lit(ladder[-1])
    for k in reversed(ladder[:-1]):
        total = F.aggregate(F.transform(lengths, lambda n: F.least(n.cast("int"), F.lit(k))), F.lit(0), lambda s, n: s + n)  # noqa: B023
        out = F.when(F.floor(total / 4) <= limit, k).otherwise(out)
    return out
