"""One text of 50 MB: whole results, with working memory that follows segments and frames rather than the text."""

import random
import resource
import zlib

import numpy as np

from convlake.llm import flac, textkit
from convlake.llm.media import store_payloads
from convlake.llm.neardup import near_duplicates


def long_text(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    some = " ".join(r.choice(words) for _ in range(200_000))
    return (some + " ") * (n // len(some) + 1)


def test_hashes_by_stretches_are_those_of_the_whole():
    data = np.frombuffer(long_text(6 << 20)[: 6 << 20].encode(), np.uint8)
    begin, end, _ = textkit.words(data, np.array([0, len(data)]))
    assert (textkit.span_hashes(data, begin, end) == textkit._span_hashes(data, begin, end)).all()
    word = np.frombuffer(b"x" * (7 << 20), np.uint8)
    assert len(textkit.span_hashes(word, np.array([0]), np.array([len(word)]))) == 1


def test_a_long_payload_goes_frame_by_frame():
    payload = long_text(50 << 20)[: 192 * 260_000].encode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    stream = flac.encode([payload])[0]
    assert flac.decode([stream]) == [payload]
    assert flac.read_samples(stream, 31_000_000, 5000) == payload[31_000_000:31_005_000]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # KB; a few times the text


def test_a_long_text_in_tables(spark):
    text = long_text(50 << 20)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    docs = docs.unionByName(spark.range(3, 5).selectExpr("id as doc_id").crossJoin(spark.createDataFrame([(text,)], "text string")))
    got = {r.doc_id: r for r in near_duplicates(docs, size=4).collect()}
    words = text.split()
    assert got[3].n_shingles == len(set(zip(words, words[1:], words[2:], words[3:]))) and (got[4].component_id, got[4].kept) == (3, False)
    stored = {r.doc_id: r for r in store_payloads(docs.selectExpr("doc_id", "cast(text as binary) as payload"), keep_media=False).collect()}
    assert stored[3].n_bytes == len(text) and stored[3].payload_sha256 == stored[4].payload_sha256
    assert stored[3].tail_crc32 == zlib.crc32(text.encode().ljust(stored[3].payload_bytes)[-16:])
